import hashlib
import random
import re

from pyspark.sql import functions as F

from offerloom.llm import pii, quotes, warc

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark):
    rng = random.Random(2)
    texts = [None, "", "a@b.c_d@e.f a@b a@b.c.d.@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 007.08.9.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (212) 555-0199 +12",
             "é" * 50 + "\U0001f600 a@b.cd", "1" * 20000, "a" * 100000 + "@", "+1" + " " * 5000, "a." * 5000 + "@b.c" + ".d" * 5000]
    texts += ["".join(rng.choice("ab@.+-_0123456789 ()é\U0001f600") for _ in range(rng.randrange(150))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans_found string").repartition(3)
    base = F.filter("spans_found", lambda s: s["kind_no"] < len(pii.BASE))
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(base).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert pii.find(docs.limit(0)).collect() == []


def test_checked_and_contextual_spans(spark):
    docs = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 x"), (2, "IBAN DE89 3704 0044 0532 0130 01 x"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    rows = {r.doc_id: (r.s, r.text) for r in pii.redact(docs).select("doc_id", "text", pii.written(F.col("spans_found")).alias("s")).collect()}
    assert rows == {1: ("iban:5:32", "IBAN <IBAN> x"), 2: ("", docs.collect()[1].text), 3: ("ssn:4:15", "ssn <SSN>"), 4: ("", "part 123-45-6789")}


def test_iban_ends_where_its_country_says(spark):
    docs = spark.createDataFrame([(1, "IBAN GB29 NWBK 6016 1331 9268 19 BIC ABC"), (2, "iban NO93 8601 1117 947 AND MORE"), (3, "IBAN ZZ29 NWBK 6016 1331 9268 19"), (4, None)], "__email long, text string")
    rows = {r["__email"]: r.s for r in pii.find(docs).select("__email", pii.written(F.col("spans_found")).alias("s")).collect()}
    assert rows == {1: "iban:5:32", 2: "iban:5:23", 3: "", 4: ""}


def test_archive(spark, tmp_path):
    long = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    pages = spark.createDataFrame([(1, "http://a.example/x", long, 5), (9, "http://b.example/", long, 5), (4, None, None, 5), (5, "u", "short", 5), (6, "u", "short", 5), (7, "r", long + "!", 5), (7, "r", long + "!", 5)],
                                  "page_id long, url string, html string, type int")
    warc.write(pages, str(tmp_path / "w"))
    rows = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    page = lambda s: int(re.search(r"capture:(\d+)-", s).group(1))
    got = sorted((page(r.response.id), r.response.type, r.response.refers_to and page(r.response.refers_to)) for r in rows)
    assert got == [(1, "revisit", 9), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7), (9, "response", None)]
    for r in rows:
        assert r.n_requests == r.n_metadata == 1 and r.request.target == r.response.target and r.metadata.concurrent_to == r.request.id
        if r.response.type == "response":
            body = bytes(r.response.payload)
            assert hashlib.sha1(body).hexdigest() == r.response.payload_digest.removeprefix("sha1:") and len(body) == r.response.http_length
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "none"))).collect() == []


def test_records_named_from_either_side(spark):
    rows = [("response", "r1", "q1"), ("request", "q1", None), ("metadata", "m1", "q1"), ("metadata", "lost", "gone"), ("response", "r2", None), ("request", "q2", "r2")]
    records = spark.createDataFrame(rows, "type string, id string, concurrent_to string")
    got = {(r.response and r.response.id, r.request and r.request.id, r.metadata and r.metadata.id) for r in warc.assemble(records).collect()}
    assert got == {("r1", "q1", "m1"), ("r2", "q2", None), (None, None, "lost")}


def test_records_that_name_each_other_in_a_ring(spark):
    ring = [("request", f"x{i}", f"x{(i + 1) % 3}") for i in range(3)] + [("metadata", "y0", "y1"), ("request", "y1", "y0"), ("request", "z", "z")]
    records = spark.createDataFrame([("response", "r1", None), ("request", "q1", "r1"), *ring], "type string, id string, concurrent_to string")
    got = {(r.capture, r.response and r.response.id, r.n_requests, r.n_metadata) for r in warc.assemble(records).collect()}
    assert got == {("r1", "r1", 1, 0), ("x0", None, 3, 0), ("y0", None, 1, 1), ("z", None, 1, 0)}


def test_threads(spark):
    mails = [(1, 1, "Shall we meet?\n\nAt noon."), (1, 2, "Yes.\n\nOn Monday someone wrote:\n> Shall we  MEET?\n>\n> At noon."), (1, 3, "> Yes.\n> On Monday someone wrote:\n> > At noon.\nGood."),
             (1, 4, "> never said\nOn wrote:"), (1, 5, None), (1, 6, ""), (2, 1, "> Yes.\nother scope"), (None, 1, "x"), (1, 1, "Shall we meet?\n\nAt noon.")]
    rows = {(r.conv_id, r.turn): r for r in quotes.thread(spark.createDataFrame([(a, b, t, "p") for a, b, t in mails], "conv_id long, turn long, text string, root string")).collect()}
    assert {k: (r.parent, r.root, r.depth, r.n_quoted, r.n_linked) for k, r in rows.items()} == {
        (1, 1): (None, 1, 0, 0, 0), (1, 2): (1, 1, 1, 2, 2), (1, 3): (2, 1, 2, 2, 2), (1, 4): (None, 4, 0, 1, 0), (1, 5): (None, 5, 0, 0, 0), (1, 6): (None, 6, 0, 0, 0), (2, 1): (None, 1, 0, 1, 0)}
    assert rows[1, 2].own_text == "Yes." and rows[1, 3].own_text == "Good." and rows[1, 5].own_text == ""
