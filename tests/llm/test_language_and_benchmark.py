import random

import numpy as np
from pyspark.sql import functions as F

from offerloom.llm import decontaminate, langid

# Own syllables per invented language.
SOUNDS = {"aa": "ka to mi ru sen da lo", "bb": "gra vel tor ung sch pfi ost", "cc": "oui elle eau tre ment ique ail", "dd": "zó ñar ción los dad illo que"}


def written(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(spark):
    rng = random.Random(6)
    rows = [(i, written(rng, lang, rng.randrange(8, 80)), lang, "x") for i, lang in enumerate(rng.choice(list(SOUNDS)) for _ in range(600))]
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "123 --- \U0001f600", "bb", "x"), (903, written(rng, "bb", 30), None, "x"), (904, "한", "cc", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in langid.predict(docs, model, keep=("doc_id", "lang", "score")).select("*", langid.held_out().alias("held_out")).collect()}
    assert len(rows) == 605
    tried = [r for r in rows.values() if r.held_out and r.doc_id < 900]
    assert len(tried) > 80 and sum(r.lang == r.lang_pred for r in tried) / len(tried) > 0.97
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (900, 901, 902))
    assert rows[903].lang_pred == "bb" and rows[904].lang_pred in SOUNDS and all(0 <= r.score <= 1 for r in rows.values())
    # The same profiles, however the rows are dealt.
    again = langid.fit(docs.where(~langid.held_out()).repartition(1))
    assert np.array_equal(model.weights, again.weights)


def test_nothing_learned_and_one_language(spark):
    docs = corpus(spark)
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 900"), one).collect()} == {"aa"}
    assert langid.predict(docs.limit(0), one).collect() == []


def test_codewords_keep_their_distance():
    for classes in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(classes).astype(int)
        assert len({tuple(r) for r in code}) == classes
        if classes > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def plain_distance(item, window):
    before = list(range(len(item) + 1))
    best = before[-1]
    for c in window:
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (x != c)))
        before = now
        best = min(best, now[-1])
    return best


def test_least_distance():
    rng = random.Random(2)
    for _ in range(500):
        item, window = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(low, 25))) for low in (1, 0))
        assert decontaminate.least_distance(decontaminate._marks(item), len(item), window, 9) == plain_distance(item, window)


def test_matches_and_recall(spark):
    rng = random.Random(8)
    items = [written(rng, "bb", rng.randrange(14, 50)) for _ in range(30)]
    rows, planted = [], {}
    for i in range(200):
        k = rng.randrange(30)
        body = list(items[k])
        for _ in range(int(0.08 * len(body)) if i % 2 else 0):
            body[rng.randrange(len(body))] = rng.choice("xyz")
        planted[i] = k
        rows.append((i, written(rng, "bb", 40) + "\n" + "".join(body).upper() + " " + written(rng, "bb", 40), "x"))
    rows += [(1000 + i, written(rng, "cc", 200), "x") for i in range(50)] + [(None, items[0], "x"), (2000, None, "x"), (2001, "", "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance string").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(77, None), (78, ""), (79, "too short")], "item_id long, text string")
    found = decontaminate.matches(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert all((i, k) in got for i, k in planted.items() if i % 2 == 0)
    assert sum((i, k) in got for i, k in planted.items()) >= 0.9 * len(planted)
    fold = lambda t: decontaminate.folded(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][:-1].tobytes()
    texts = {r[0]: r[1] for r in rows}
    for r in found[:40]:
        assert r.distance == plain_distance(fold(items[r.item_id]).strip(), fold(texts[r.doc_id]))
    left = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert left >= {*range(1000, 1050), 2000, 2001} and None not in left and not left & {i for i in planted if i % 2 == 0}
    assert decontaminate.matches(docs.limit(0), bench).collect() == [] and decontaminate.matches(docs, bench.limit(0)).collect() == []


def test_items_without_blanks_and_short_items(spark):
    han = "港の事務所は朝早く開き職員たちは雨の降る埠頭で届いた手紙を静かに仕分けていた"
    rng = random.Random(3)
    code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(90))
    ask = "What is the capital of France?"
    docs = spark.createDataFrame([
        (1, "昨日の新聞によれば" + han + "という話が町で広く知られている"), (2, "q7" + code + "zz8"), (3, "He asks: what is the CAPITAL of France, then"),
        (4, "what is the capital of Francesca"), (5, "私は東京都庁へ行く")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, han), (2, code), (3, ask), (4, "東京都庁"), (5, "?!")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 0)]
