"""Splits, scaling, predictions and their evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import soft_scores, top_class
from ..operators.features import (
    TRAIN,
    VALIDATION,
    apply_scaling,
    assemble_vectors,
    drop_missing_features,
    fit_scaling,
    stratified_split,
)
from ..operators.metrics import (
    accuracy,
    area_under_curve,
    confusion,
    log_loss,
    macro_auc,
    one_vs_rest_auc,
)
from ..operators.boosting import binned, level_sums, split_gains, with_gradients
from ..operators.models import fit_boosted_trees, fit_relu_net, predict
from ..operators.nets import gradient_sums, start_net
from ..session import cut_lineage
from .registry import LABELLED, labelled_documents, query, table

CLASSES = tuple(range(10))
SEED = 5353456


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings taken as scores: class c has the sum of all elements at c, c + 10, c + 20 and so on."""
    values = F.col("embedding").cast("array<double>")

    def score(c: int):
        own = F.filter(values, lambda x, i: i % len(CLASSES) == c)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x)

    scores = F.array(*[score(c) for c in CLASSES])
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", scores.alias("scores"), top_class(scores).alias("prediction")
    )


SCORES = (
    "e AS (SELECT vec_id, label, list_transform(range(0, 10), lambda c: list_reduce(list_filter("
    "embedding::DOUBLE[], lambda x, i: (i - 1) % 10 = c), lambda a, b: a + b, 0.0::DOUBLE)) AS s FROM embeddings)"
)
PREDICTED = SCORES + (
    ", p AS (SELECT vec_id, label, s, cast(list_position(s, list_max(s)) - 1 AS INTEGER) "
    "AS prediction FROM e)"
)


@query(f"WITH {PREDICTED} SELECT vec_id, prediction FROM p")
def top_class_rows(spark: SparkSession, folder: str) -> DataFrame:
    return class_scores(spark, folder).select("vec_id", "prediction")


@query(
    f"WITH {SCORES}, x AS (SELECT vec_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS class "
    "FROM e) SELECT vec_id, cast(class AS INTEGER) AS class, "
    "round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id), 9) AS score FROM x"
)
def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = class_scores(spark, folder).withColumn("scores", soft_scores("scores"))
    long = scores.select("vec_id", F.posexplode("scores").alias("class", "score"))
    return long.withColumn("score", F.round("score", 9))


@query(
    f"WITH {PREDICTED} SELECT label, "
    + ", ".join(f"count(*) FILTER (WHERE prediction = {c}) AS predicted_{c}" for c in CLASSES)
    + " FROM p GROUP BY label",
    name="confusion",
)
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return confusion(class_scores(spark, folder), "label", "prediction", CLASSES)


@query(
    f"WITH {PREDICTED} SELECT (count(*) FILTER (WHERE label = prediction))::DOUBLE / count(*) "
    "AS accuracy FROM p",
    name="accuracy",
)
def accuracy_of_top_class(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy(class_scores(spark, folder), "label", "prediction")


@query(
    f"WITH {SCORES}, v AS (SELECT vec_id, unnest(s) AS v FROM e), "
    "z AS (SELECT vec_id, sum(exp(v)) AS z FROM v GROUP BY vec_id) "
    "SELECT round(avg(ln(z) - s[label + 1]), 9) AS log_loss FROM e JOIN z ON e.vec_id = z.vec_id"
)
def softmax_log_loss(spark: SparkSession, folder: str) -> DataFrame:
    scores = class_scores(spark, folder).withColumn("scores", soft_scores("scores"))
    return log_loss(scores, "label", "scores").select(F.round("log_loss", 9).alias("log_loss"))


# Mean ranks of the positives, ties sharing theirs.
AUC = (
    "SELECT {keys}(sum(r) FILTER (WHERE own) - pos * (pos + 1) / 2.0::DOUBLE) "
    "/ nullif(pos::DOUBLE * (n - pos), 0) AS auc FROM (SELECT {keys}own, "
    "rank() OVER (PARTITION BY {part} ORDER BY v) "
    "+ (count(*) OVER (PARTITION BY {part}, v) - 1) / 2.0::DOUBLE AS r, "
    "count(*) FILTER (WHERE own) OVER (PARTITION BY {part}) AS pos, "
    "count(*) OVER (PARTITION BY {part}) AS n FROM x) GROUP BY {keys}pos, n"
)
BY_CLASS = (
    f"WITH {SCORES}, x AS (SELECT cast(c AS INTEGER) AS class, label = c AS own, s[c + 1] AS v "
    "FROM e, range(10) AS t(c)), a AS (" + AUC.format(keys="class, ", part="class") + ") "
)


@query(BY_CLASS + "SELECT class, auc FROM a")
def ovr_auc(spark: SparkSession, folder: str) -> DataFrame:
    return one_vs_rest_auc(class_scores(spark, folder), "label", "scores")


@query(BY_CLASS + "SELECT round(avg(auc), 9) AS macro_auc FROM a", name="macro_auc")
def macro_auc_of_scores(spark: SparkSession, folder: str) -> DataFrame:
    by_class = one_vs_rest_auc(class_scores(spark, folder), "label", "scores")
    return macro_auc(by_class).select(F.round("macro_auc", 9).alias("macro_auc"))


@query(
    f"WITH {LABELLED}, x AS (SELECT lang, quality = 1 AS own, n_chars AS v FROM d "
    "WHERE quality IS NOT NULL), a AS ("
    + AUC.format(keys="lang, ", part="lang")
    + ") SELECT lang, auc FROM a"
)
def length_auc_by_language(spark: SparkSession, folder: str) -> DataFrame:
    judged = labelled_documents(spark, folder).na.drop(subset=["quality"])
    return area_under_curve(judged, ["lang"], F.col("quality") == 1, F.col("n_chars"))


PART_SCALING = (
    "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, "
    "round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) "
    "AS p_retailprice FROM part"
)


@query(PART_SCALING)
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["p_size", "p_retailprice"]
    parts = table(spark, folder, "part").select("p_partkey", *columns)
    scaled = apply_scaling(parts, fit_scaling(parts, columns), columns)
    return scaled.select("p_partkey", *[F.round(c, 6).alias(c) for c in columns])


@query(
    f"WITH {LABELLED} SELECT doc_id, "
    "round((n_chars - (SELECT avg(n_chars) FROM d)) / (SELECT stddev_pop(n_chars) FROM d), 6) "
    "AS n_chars, round((quality - (SELECT avg(quality) FROM d)) "
    "/ (SELECT coalesce(nullif(stddev_pop(quality), 0), 1) FROM d), 6) AS quality FROM d"
)
def standard_scale_missing(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["n_chars", "quality"]
    documents = labelled_documents(spark, folder).select("doc_id", *columns)
    scaled = apply_scaling(documents, fit_scaling(documents, columns), columns)
    return scaled.select("doc_id", *[F.round(c, 6).alias(c) for c in columns])


# Largest-remainder quotas in whole numbers, for any table g(label, n).
QUOTAS = (
    "SELECT g.label, g.n, g.n * t.k // t.n + (row_number() OVER "
    "(ORDER BY g.n * t.k % t.n DESC, g.label) <= t.k - sum(g.n * t.k // t.n) OVER ())::INTEGER AS q "
    "FROM {0} g, (SELECT sum(n)::BIGINT AS n, ceil(0.1::DOUBLE * sum(n))::BIGINT AS k FROM {0}) t"
)
SPLIT_SIZES = (
    "g AS (SELECT label, count(*) AS n FROM l GROUP BY label), a AS ("
    + QUOTAS.format("g")
    + "), h AS (SELECT label, n - q AS n FROM a), b AS ("
    + QUOTAS.format("h")
    + ") SELECT label, split, cast(rows AS BIGINT) AS rows FROM ("
    "SELECT label, 'test' AS split, q AS rows FROM a UNION ALL "
    "SELECT label, 'validation', q FROM b UNION ALL SELECT label, 'train', n - q FROM b)"
)


def split_sizes(parts: DataFrame, label: str) -> DataFrame:
    return parts.groupBy(F.col(label).alias("label"), "split").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH l AS (SELECT quality AS label FROM labels), " + SPLIT_SIZES, name="stratified_split")
def stratified_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    parts = stratified_split(table(spark, folder, "labels"), "doc_id", "quality", [0, 1], SEED)
    return split_sizes(parts, "quality")


@query(
    "WITH l AS (SELECT l_linenumber AS label FROM (SELECT o_orderkey, "
    "cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS l_linenumber FROM orders)), " + SPLIT_SIZES
)
def stratified_split_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level")
    )
    parts = stratified_split(orders, "o_orderkey", "level", [1, 2, 3, 4, 5], SEED)
    return split_sizes(parts, "level")


def split_rows_sql(table: str, row_id: str, label: str) -> str:
    """CTEs up to ``r``: id, label and split of every row of ``table`` that has a label."""
    return (
        f"l AS (SELECT {row_id} AS id, {label} AS label FROM {table}), "
        "g AS (SELECT label, count(*) AS n FROM l GROUP BY label), a AS ("
        + QUOTAS.format("g")
        + "), h AS (SELECT label, n - q AS n FROM a), b AS ("
        + QUOTAS.format("h")
        + "), o AS (SELECT id, l.label, row_number() OVER (PARTITION BY l.label ORDER BY "
        f"('0x' || substr(md5('{SEED}:' || id), 1, 15))::BIGINT, id) AS place FROM l), "
        "r AS (SELECT id, o.label, CASE WHEN place <= a.q THEN 'test' WHEN place <= a.q + b.q THEN 'validation' "
        "ELSE 'train' END AS split FROM o JOIN a ON o.label = a.label JOIN b ON o.label = b.label)"
    )


@query(
    "WITH " + split_rows_sql("labels", "doc_id", "quality")
    + " SELECT doc_id, quality, toxic, split FROM labels JOIN r ON doc_id = id"
)
def stratified_split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(table(spark, folder, "labels"), "doc_id", "quality", [0, 1], SEED)


@query(
    "SELECT p_partkey, p_size::DOUBLE AS first, p_retailprice AS second, "
    "cast(substr(p_brand, 7) AS DOUBLE) - 1 AS label FROM part"
)
def vector_and_label(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn(
        "class", F.substring("p_brand", 7, 9).cast("int") - 1
    )
    vectors = assemble_vectors(parts, ["p_size", "p_retailprice"], "class", keep=["p_partkey"])
    elements = vector_to_array("features")
    return vectors.select(
        "p_partkey", elements[0].alias("first"), elements[1].alias("second"), "label"
    )


@query(f"WITH {LABELLED} SELECT doc_id, quality, toxic FROM d "
       "WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_incomplete_vectors(spark: SparkSession, folder: str) -> DataFrame:
    documents = labelled_documents(spark, folder).select("doc_id", "quality", "toxic")
    return drop_missing_features(documents, ["quality", "toxic"])


def embedding_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Split once and kept as files for the fits, then one column per element of the
    widest vector. What a narrower one lacks is missing, as in any other feature."""
    split = stratified_split(table(spark, folder, "embeddings"), "vec_id", "label", CLASSES, SEED)
    parts = cut_lineage(split)
    width = parts.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(width)]
    elements = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    return parts.select("vec_id", "label", "split", *elements), names


def held_out_scores(model, parts: DataFrame) -> DataFrame:
    held_out = parts.filter(F.col("split") == VALIDATION)
    return predict(model, held_out, "label", len(CLASSES)).select("vec_id", "label", "prediction", "scores")


def boosted_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    parts, names = embedding_parts(spark, folder)
    train = parts.filter(F.col("split") == TRAIN)
    return held_out_scores(fit_boosted_trees(train, names, "label", classes=len(CLASSES)), parts)


def net_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    parts, names = embedding_parts(spark, folder)
    train = parts.filter(F.col("split") == TRAIN)
    return held_out_scores(fit_relu_net(train, names, "label", len(CLASSES), seed=SEED), parts)


@query()
def boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    return boosted_embeddings(spark, folder)


@query()
def neural_net(spark: SparkSession, folder: str) -> DataFrame:
    return net_embeddings(spark, folder)


# What SQL can say of any model's output: which rows it scores, and how scores and prediction hang together.
SCORED = (
    "WITH " + split_rows_sql("embeddings", "vec_id", "label")
    + " SELECT id AS vec_id, label, 10 AS classes, TRUE AS sums_to_one, TRUE AS within, TRUE AS top FROM r WHERE split = 'validation'"
)


def scores_hang_together(scored: DataFrame) -> DataFrame:
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(
        "vec_id", "label", F.size("scores").alias("classes"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.forall("scores", lambda x: (x >= 0) & (x <= 1)).alias("within"),
        (F.element_at("scores", F.col("prediction") + 1) == F.array_max("scores")).alias("top"),
    )


@query(SCORED)
def boosted_trees_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scores_hang_together(boosted_embeddings(spark, folder))


@query(SCORED)
def neural_net_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scores_hang_together(net_embeddings(spark, folder))


# Three numbers of a line and the class it falls into, with missing values among them.
LINE_CLASSES = 4
LINE_FEATURES = {
    "f0": "case when l_linenumber = 3 then null else l_quantity end",
    "f1": "l_discount * 100",
    "f2": "case when l_returnflag = 'A' and l_tax > 0.05 then null else l_tax * 100 end",
}
LINE_LABEL = "case l_returnflag when 'A' then 0 when 'N' then 1 + cast(l_linenumber % 2 as int) else 3 end"
LINE_EDGES = ([10.0, 20.0, 30.0, 40.0], [2.5, 5.5, 8.5], [1.5, 4.5])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    named = [F.expr(sql).cast("double").alias(name) for name, sql in LINE_FEATURES.items()]
    return table(spark, folder, "lineitem").select(*named, F.expr(LINE_LABEL).cast("int").alias("label"))


def gains_sql(l1: float = 10.0, l2: float = 1.0, least: float = 1.0) -> str:
    """The first level's split gains: every class has the same score in every row."""
    share = 1 / LINE_CLASSES
    bins = [
        f"CASE WHEN {sql} IS NULL THEN 0 ELSE 1 + " + " + ".join(f"(({sql}) >= {e})::INTEGER" for e in own) + " END"
        for (name, sql), own in zip(LINE_FEATURES.items(), LINE_EDGES)
    ]
    worth = "pow(sign({0}) * greatest(abs({0}) - %s::DOUBLE, 0), 2) / ({1} + %s::DOUBLE)" % (l1, l2)
    left = "(low_{0} + CASE WHEN missing_left THEN gone_{0} ELSE 0 END)"
    lg, lh = left.format("g"), left.format("h")
    return (
        f"WITH x AS (SELECT {LINE_LABEL} AS label, unnest([{', '.join(bins)}]) AS bin, "
        "unnest([0, 1, 2]) AS feature FROM lineitem), "
        f"s AS (SELECT CAST(c AS INTEGER) AS class, feature, bin, "
        f"sum({share}::DOUBLE - (label = c)::INTEGER) AS g, sum({2 * share * (1 - share)}::DOUBLE) AS h "
        f"FROM x, range({LINE_CLASSES}) AS t(c) GROUP BY ALL), "
        "w AS (SELECT *, sum(g) OVER p AS all_g, sum(h) OVER p AS all_h, "
        "coalesce(sum(g) FILTER (bin = 0) OVER p, 0) AS gone_g, coalesce(sum(h) FILTER (bin = 0) OVER p, 0) AS gone_h, "
        "coalesce(sum(g) FILTER (bin > 0) OVER (PARTITION BY class, feature ORDER BY bin), 0) AS low_g, "
        "coalesce(sum(h) FILTER (bin > 0) OVER (PARTITION BY class, feature ORDER BY bin), 0) AS low_h "
        "FROM s WINDOW p AS (PARTITION BY class, feature)), "
        "m AS (SELECT * FROM w, (VALUES (TRUE), (FALSE)) AS b(missing_left)) "
        f"SELECT class, feature, CAST(bin AS INTEGER) AS bin, missing_left, CASE WHEN bin > 0 AND {lh} >= {least} AND all_h - {lh} >= {least} "
        f"THEN round({worth.format(lg, lh)} + {worth.format(f'(all_g - {lg})', f'(all_h - {lh})')} "
        f"- {worth.format('all_g', 'all_h')}, 4) END AS gain FROM m"
    )


@query(gains_sql())
def boosted_split_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Every first split that boosting weighs, on quantity, discount and tax of all lines."""
    placed = binned(lines(spark, folder), list(LINE_FEATURES), LINE_EDGES)
    even = with_gradients(placed.withColumn("margins", F.array_repeat(F.lit(0.0), LINE_CLASSES)), LINE_CLASSES)
    gains = split_gains(level_sums(even, [(k, 0) for k in range(LINE_CLASSES)]))
    return gains.select("class", "feature", "bin", "missing_left", F.round("gain", 4).alias("gain"))


HIDDEN = 3


def net_step_sql() -> str:
    """Loss, accuracy and gradient sums of the first weights, all products spelled out."""
    net = start_net(list(LINE_FEATURES), LINE_CLASSES, HIDDEN, SEED)

    def line(weights, names) -> str:
        return " + ".join(f"({w!r})::DOUBLE * {n}" for w, n in zip(weights, names))

    inputs = [*LINE_FEATURES, "1"]
    units = [f"a{i}" for i in range(HIDDEN)]
    sql = "WITH x AS (SELECT " + ", ".join(f"({q})::DOUBLE / 10 AS {n}" for n, q in LINE_FEATURES.items()) + f", {LINE_LABEL} AS label FROM lineitem), "
    sql += "h AS (SELECT *, " + ", ".join(f"greatest({line(w, inputs)}, 0) AS a{i}" for i, w in enumerate(net.hidden))
    sql += " FROM x WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in LINE_FEATURES) + "), "
    sql += "z AS (SELECT *, " + ", ".join(f"exp({line(w, [*units, '1'])}) AS e{k}" for k, w in enumerate(net.output)) + " FROM h), "
    whole = " + ".join(f"e{k}" for k in range(LINE_CLASSES))
    sql += "d AS (SELECT *, " + ", ".join(f"e{k} / ({whole}) - (label = {k})::INTEGER AS d{k}" for k in range(LINE_CLASSES)) + " FROM z), "
    back = [line([w[i] for w in net.output], [f"d{k}" for k in range(LINE_CLASSES)]) for i in range(HIDDEN)]
    sql += "b AS (SELECT *, " + ", ".join(f"CASE WHEN a{i} > 0 THEN {own} ELSE 0 END AS b{i}" for i, own in enumerate(back)) + " FROM d) "
    own = "CASE label " + " ".join(f"WHEN {k} THEN e{k}" for k in range(LINE_CLASSES)) + " END"
    top = f"{own} = greatest({', '.join(f'e{k}' for k in range(LINE_CLASSES))})"
    sums = ["count(*)", f"sum(-ln({own} / ({whole})))", f"sum(({top})::INTEGER)"]
    sums += [f"sum(b{i} * {n})" for i in range(HIDDEN) for n in inputs]
    sums += [f"sum(d{k} * {n})" for k in range(LINE_CLASSES) for n in [*units, "1"]]
    return sql + "SELECT [" + ", ".join(f"({s})::DOUBLE" for s in sums) + "] AS v FROM b"


def net_step_query() -> str:
    sums = net_step_sql()
    return f"WITH t AS ({sums}) SELECT CAST(unnest(range(len(v))) AS INTEGER) AS place, round(unnest(v), 3) AS total FROM t"


@query(net_step_query())
def relu_net_first_step(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, loss, right ones and every weight's gradient before the first step, summed over all complete lines."""
    net = start_net(list(LINE_FEATURES), LINE_CLASSES, HIDDEN, SEED)
    scaled = lines(spark, folder).withColumns({n: F.col(n) / 10 for n in LINE_FEATURES})
    rows = net.complete(scaled).select(net.inputs().alias("x"), "label")
    return gradient_sums(net, rows).select(F.posexplode("total").alias("place", "total")).select("place", F.round("total", 3).alias("total"))
