"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.llm.lines import dedup_lines
from areaframe.llm.minhash import MinHash, representatives
from areaframe.llm.mixing import mix_sources, with_sizes
from areaframe.llm.quality import judge, learn, with_stats
from areaframe.llm.queries import table
from areaframe.llm.sentencepieces import encode
from areaframe.llm.shared import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learnt rule rejects go.

    A null or wordless text has no words and goes. Labels that disagree are weighed as they stand; without labels only the base
    rule is left. Rows that share an id are judged each by its own text. An empty table stays empty."""
    measured = with_stats(docs.select(*COLUMNS))
    stats = save(measured.drop("text", "lang", "source", "n_chars"), "stats")
    rules = learn(stats, table(spark, sf_dir, "labels"))
    return judge(measured, rules).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except where the smallest document holds them. Documents stay.

    Rows that share an id are one document here; rows without an id neither give nor lose lines. A null text stays null, and an
    empty table empty. ``n_chars`` is counted anew where lines went."""
    kept = dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; of five-word
    shingles, at a similarity of 0.8.

    Documents without words are no one's copies and all stay. Rows that share an id are documents of their own, told apart by
    their texts; of rows equal in both one stays. A null id takes part like any other and stays only where its group has no
    other. An empty table stays empty."""
    stay, repeated = representatives(docs.select("doc_id", "text"), params=MinHash())
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))

    def same(other: DataFrame) -> Column:
        return (F.col("_hash") == other["th"]) & F.col("doc_id").eqNullSafe(other["id"])

    # Merged at every size: as a broadcast it would do for small corpora only.
    kept = hashed.join(stay.hint("merge"), same(stay), "left_semi")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, same(repeated), "left_anti")
    several = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return once.union(several).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that agree in id, source and size are taken alike. A null source is a source, a null id an id; a null or wordless
    text has size 0. An empty table stays empty."""
    sized = with_sizes(docs.select(*COLUMNS))
    slim = save(sized.select("doc_id", "source", "size"), "sizes")
    times = save(mix_sources(slim).select("doc_id", "source", "size", "times").distinct(), "times")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size")]
    taken = sized.join(
        # Merged at every size, as in the stage before.
        times.filter("times > 0").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "times").hint("merge"),
        same[0] & same[1] & same[2],
    )
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it.

    A null text has null ids, an empty one none. Rows are encoded one by one, so repeated ones come out alike."""
    return encode(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", "token_ids", "n_tokens", "round_trip"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]

#: Learnt rules, random sampling and token ids are not for SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
