"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = lambda spark, folder: plan(configure(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return add


@query("op5_prefix_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


@query("op4_output_codes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from . import langid

    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "second")


@query("op2_fertility")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import fertility

    use = fertility.Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.RATES, "reason")
    return fertility.verdicts(fertility.measure(table(spark, folder, "documents"), use)).select(*columns)


@query("op3_substrings")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from . import substrings

    return substrings.remove_repeated(table(spark, folder, "documents"), 35, digest=True)


@query("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from . import jaccard

    return jaccard.link(table(spark, folder, "documents"), 85)


_OP7_SQL = """
with bodies as (select page_id, url, coalesce(html, '') as body from pages),
     sized as (select page_id, url, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as payload_digest from bodies),
     ranked as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from sized)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to,
       cast(page_id as varchar) as metadata_page, url as request_target
from ranked
"""


@query("op7_warc_transactions", _OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from ..session import fresh_path
    from . import warc

    path = fresh_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    captures = warc.assemble(warc.read(spark, path, payloads=False).drop("payload"))
    page = lambda c: F.regexp_extract(c, "<urn:capture:(-?[0-9]+)-", 1).cast("bigint")
    response, again = F.col("response"), F.col("response.type") == "revisit"
    return captures.select(
        page("response.id").alias("page_id"), F.when(again, response["http_length"]).otherwise(response["payload_length"]).alias("payload_bytes"),
        F.when(again, F.regexp_replace(response["payload_digest"], "^sha1:", "")).otherwise(response["payload_sha1"]).alias("payload_digest"),
        response["type"].alias("record_type"), F.when(again, page("response.refers_to")).alias("refers_to"),
        F.regexp_extract("metadata.fields", "pageId: ([0-9-]*)", 1).alias("metadata_page"), F.col("request.target").alias("request_target"))


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from . import pii

    found = pii.find(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans_found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans_found", lambda s: s["kind_no"] < len(pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans_found")).alias("spans"),
                        F.array_min(F.transform("spans_found", lambda s: s["score"])).alias("least_score"))


_OP1_SQL = r"""
with recursive norm as (
  select conv_id, turn, text, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) as said from conversations),
firsts as (select conv_id, said, min(turn) as turn from norm where said <> '' group by all),
parents as (
  select n.conv_id, n.turn, n.text, p.turn is not null and p.said <> '' as quotes, pp.turn is not null and pp.said <> '' as deep, f.turn as parent, ff.turn as grand
  from norm n left join norm p on p.conv_id = n.conv_id and p.turn = n.turn - 1 left join firsts f on f.conv_id = p.conv_id and f.said = p.said
  left join norm pp on pp.conv_id = n.conv_id and pp.turn = n.turn - 2 left join firsts ff on ff.conv_id = pp.conv_id and ff.said = pp.said),
held as (select *, coalesce(parent, grand) as up from parents),
walk as (
  select conv_id, turn, turn as root, 0 as depth from held where up is null
  union all
  select h.conv_id, h.turn, w.root, w.depth + 1 from held h join walk w on w.conv_id = h.conv_id and w.turn = h.up)
select h.conv_id, h.turn, h.up as parent, w.root, cast(w.depth as bigint) as depth,
       cast(cast(quotes as int) + cast(deep as int) as bigint) as n_quoted, cast(cast(quotes as int) + cast(deep as int) as bigint) as n_linked,
       sha256(trim(h.text, E'\n \t\r')) as own_sha256
from held h join walk w using (conv_id, turn)
"""


def mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as mail: each turn quotes the turn before, and that one's quote of the one before it."""
    turns = table(spark, folder, "conversations")
    cited = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))
    last = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("r1"), F.col("text").alias("t1"))
    older = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("role").alias("r2"), F.col("text").alias("t2"))
    body = F.concat_ws(
        "\n", "text", F.when(F.col("t1").isNotNull(), F.concat(F.lit("\nOn the last turn "), F.col("r1"), F.lit(" wrote:\n"), cited(F.col("t1"), "> "))),
        F.when(F.col("t2").isNotNull(), F.concat(F.lit("> On an older turn "), F.col("r2"), F.lit(" wrote:\n"), cited(F.col("t2"), "> > "))))
    return turns.join(last, ["conv_id", "turn"], "left").join(older, ["conv_id", "turn"], "left").select("conv_id", "turn", body.alias("text"))


@query("op1_quotes", _OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from . import quotes

    return quotes.thread(mailbox(spark, folder)).select(
        "conv_id", "turn", "parent", "root", "depth", "n_quoted", "n_linked", F.sha2("own_text", 256).alias("own_sha256"))


@query("op6_fuzzy_lines")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from . import fuzzy_lines

    out = fuzzy_lines.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_decontaminate")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_merkle")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from . import merkle

    docs = table(spark, folder, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf({"text": lowered}))
    made = merkle.manifest(docs, carry={"doc_id": F.col("doc_id"), "tampered": tampered})

    def check(batches):
        for batch in batches:
            shown, folded = [], []
            digests = pc.coalesce(batch.column("tampered"), batch.column("leaf")).to_pylist()
            for digest, proof in zip(digests, batch.column("proof").to_pylist()):
                shown.append(merkle.siblings_digest(proof))
                folded.append(merkle.fold(digest, proof))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shown, pa.string()), pa.array(folded, pa.string())],
                                             names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proofs = made.proofs(("doc_id", "tampered")).select("doc_id", "leaf", "subroot", "root", "tampered", "proof")
    return proofs.mapInArrow(check, shape).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_huffman_ids")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from ..session import fresh_path
    from . import huffman

    path = fresh_path(spark, "huffman")
    huffman.write(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return huffman.read(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """Texts as their words joined by one space; in a tenth of them, by id, the words from some place on repeat with some period."""
    n, h = F.size("w").cast("bigint"), F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    g = F.floor(F.col("h") / 10)
    a, p = g % F.greatest("n", F.lit(1)), F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8))
    told = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \t\n\u000b\f\r]+"), F.lit(0)).alias("w"), h.alias("h"))
    told = told.withColumn("n", n).withColumn("a", a).withColumn("p", p)
    again = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
                        lambda i: F.col("w")[F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")])
    return told.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("w")), " ").alias("text"))


@query("op12_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from . import runs

    found = runs.find(made_periodic(table(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # Exponents are compared as products, so exactly.
    above = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: F.when(above(a, b) > 0, -1).when(above(a, b) < 0, 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(
        F.signum(a["period"] - b["period"]).cast("int"))
    best = F.try_element_at(F.array_sort("runs", order), F.lit(1))
    told = found.withColumn("best", best).withColumn("told", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return told.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join("told", ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
