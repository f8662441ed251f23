"""Personal data by candidate boosting, in DataFrame expressions only.

Exact patterns with their checks find the base spans. Looser generators propose
more: anything mail-like, any run of seven or more digits with marks between, and any
long run of letters and digits, which may be a secret. A candidate is described by its
format and the text around it. What is right is told by two cues that do not look at the
base rules: a format check of its kind, and the context (what stands directly before and
after, a keyword before a secret). A candidate that both speak for is right, one that
fails its format check is wrong, and the others have no label. Boosted trees learn these labels on a bounded sample; per kind a
threshold is set, on a third of all labelled candidates that the trees have not seen, so
that those above it are right ``PRECISION`` of the time. Candidates above it are added if
they touch no base span, pass their format check and do not begin or end inside a longer
run of letters and digits. The trees become one SQL expression, so scoring needs no
shuffle and reads no text again.

Patterns are possessive and start only where a run starts; they match what the
plain ones match, without recursion or rescans on long runs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.registry import query
from tabforge.session import settle
from tabforge.sources.tables import load

#: Candidates of smallest hash; the trees are fitted on two thirds of them.
SAMPLE = 20_000
ROUNDS, DEPTH = 10, 3
PRECISION, LEAST = 0.95, 5
BINS = 50

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans; the last has no base rule.
ADDED_KINDS = [*KINDS, "secret"]
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
LOOSE_PATTERNS = {
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+",
}
_KEYWORDS = r"(?i)phone|call|tel|fax|mobile|card|visa|account|credit|ip|host|server|mail|contact|ssn"

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn's sum: every second digit from the right counts double, less nine if above nine.
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CASE WHEN d = '' THEN 0"
    " WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN 2 * int(d) - 9 ELSE 2 * int(d) END),"
    " 0, (x, y) -> x + y) % 10 = 0"
)
_CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', ltrim('0', p))) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_GUARDS = {
    "email": "instr(text, '@') > 0", "ip": "has_digit", "card": "has_digit",
    "phone": "has_digit AND instr(text, '+') > 0",
    "mail": "instr(text, '@') > 0 OR text rlike '[(\\\\[]at[)\\\\]]'", "number": "has_digit", "secret": "has_digit",
}

#: How a match looks and what is around it, but not by which sign a mail address is joined.
FEATURES = {
    "kind": "rank",
    "digits": f"length({_DIGITS})",
    "length": "length(m)",
    "dots": "length(m) - length(replace(m, '.', ''))",
    "spaces": "length(m) - length(replace(m, ' ', ''))",
    "dashes": "length(m) - length(replace(m, '-', ''))",
    "plus": "int(startswith(m, '+'))",
    "brackets": "length(m) - length(translate(m, '()', ''))",
    "groups": "size(split(m, '[^0-9]+'))",
    "longest": "array_max(transform(split(m, '[^0-9]+'), g -> length(g)))",
    "distinct": f"size(array_distinct(split({_DIGITS}, '')))",
    "luhn": f"int({_LUHN})",
    "letters_before": "int(before rlike '[A-Za-z0-9]$')",
    "space_before": "int(before = '' OR before rlike '[ \\\\n\\\\t]$')",
    "letters_after": "int(after rlike '^[A-Za-z0-9]')",
    "space_after": "int(after = '' OR after rlike '^[ \\\\n\\\\t.,;]')",
    "keyword": f"int(before rlike '{_KEYWORDS}')",
    "caps_before": "length(before) - length(translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
}
#: Format check of each kind of candidate, by its rank.
FORMAT_CUES = [
    "m rlike '[A-Za-z]{2,}$'",
    f"CASE WHEN m rlike '^[0-9]+([.][0-9]+){{3}}$' THEN {_CHECKS['ip']} ELSE false END",
    _LUHN,
    f"length({_DIGITS}) BETWEEN 10 AND 15 AND size(split(m, '[^0-9]+')) >= 3"
    " AND forall(split(m, '[^0-9]+'), g -> length(g) <= 4) AND m rlike '[+(]|[.-].*[.-]'",
    "m rlike '[A-Za-z]' AND size(split(m, '[0-9]+')) >= 5 AND size(array_distinct(split(m, ''))) >= 10 AND NOT m rlike '[-_/]{2}'",
]
_EDGES = r"(before = '' OR before rlike '[ \\n\\t(\"<:,;]$') AND (after = '' OR after rlike '^[ \\n\\t.,;:)\">!?]')"
_SECRET_WORD = r"before rlike '(?i)(token|secret|passw|pwd|key|auth|bearer|credential)[a-z]*[^A-Za-z0-9]{1,6}$'"
CONTEXT_CUES = [_EDGES, _EDGES, _EDGES, _EDGES, _SECRET_WORD]
_SPAN = "struct<start:int,stop:int,m:string>"


def _located(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add ``name``: array of (start, stop, m) of all matches, in code points.

    A match starts where the pieces and matches before it end.
    """
    guard = F.expr(_GUARDS[name])
    found = F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    gaps = F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(F.array(F.lit("")))
    rows = rows.withColumn("_gaps", F.transform(gaps, F.length))
    spans = F.expr(
        "aggregate(transform(_found, (m, i) -> struct(_gaps[i] AS gap, m)),"
        f" struct(0 AS at, cast(array() AS array<{_SPAN}>) AS spans),"
        " (s, x) -> struct(s.at + x.gap + length(x.m) AS at, concat(s.spans, array(struct("
        "s.at + x.gap AS start, s.at + x.gap + length(x.m) AS stop, x.m AS m))) AS spans)).spans"
    )
    return rows.withColumn(f"_{name}", spans).drop("_found", "_gaps")


def _with_m(sql: str) -> str:
    """Name the match of a span ``s`` for an expression that uses it many times."""
    return f"transform(array(s.m), m -> {sql})[0]"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, rank, stop) and loose (start, rank, stop, touches, cues, features) of each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    for name, pattern in (BASE_PATTERNS | LOOSE_PATTERNS).items():
        rows = _located(rows, name, pattern)
    base = ", ".join(
        f"transform(filter(_{kind}, s -> {_with_m(_CHECKS[kind])}),"
        f" s -> struct(s.start AS start, {rank} AS rank, s.stop AS stop))"
        for rank, kind in enumerate(KINDS)
    )
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    described = ", ".join(f"double({sql}) AS {name}" for name, sql in FEATURES.items())
    number = (
        f"CASE WHEN length(m) - length(replace(m, '.', '')) = 3 THEN 1"
        f" WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN 2 ELSE 3 END"
    )
    cues = ", ".join(
        "CASE rank " + " ".join(f"WHEN {k} THEN {cue}" for k, cue in enumerate(of)) + f" END AS {name}"
        for name, of in (("formed", FORMAT_CUES), ("placed", CONTEXT_CUES))
    )
    loose = (
        "transform(concat(transform(_mail, s -> struct(s.start, s.stop, s.m, 0 AS rank)),"
        f" transform(_number, s -> struct(s.start, s.stop, s.m, {_with_m(number)} AS rank)),"
        " transform(_secret, s -> struct(s.start, s.stop, s.m, 4 AS rank))),"
        " s -> struct(s.start AS start, s.rank AS rank, s.stop AS stop,"
        " exists(base, b -> b.start < s.stop AND s.start < b.stop) AS touches,"
        " transform(array(struct(s.m AS m, substring(text, greatest(1, s.start - 23), least(24, s.start)) AS before,"
        " substring(text, s.stop + 1, 8) AS after)), c -> transform(array(c.m), m -> transform(array(c.before),"
        " before -> transform(array(c.after), after -> transform(array(s.rank), rank ->"
        f" struct({described}, {cues}))[0])[0])[0])[0])[0] AS f))"
    )
    return rows.withColumn("loose", F.expr(loose)).select("doc_id", "base", "loose")


def _tree_sql(node, names: list[str]) -> str:
    """A fitted tree as nested CASE expressions."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return repr(float(node.prediction())) + "D"
    split = node.split()
    low, high = _tree_sql(node.leftChild(), names), _tree_sql(node.rightChild(), names)
    return f"CASE WHEN c.f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {low} ELSE {high} END"


def score_sql(model: GBTClassificationModel) -> str:
    """The model's probability for a candidate ``c``."""
    names = [*FEATURES]
    trees = [_tree_sql(t._java_obj.rootNode(), names) for t in model.trees]
    margin = " + ".join(f"{w!r}D * ({t})" for w, t in zip(model.treeWeights, trees))
    return f"1 / (1 + exp(-2 * ({margin})))"


def learn(rows: DataFrame) -> tuple[str | None, dict[int, float]]:
    """(score expression, threshold per kind) from candidates of all rows.

    The trees see two thirds of the ``SAMPLE`` labelled candidates of smallest hash.
    Thresholds are set by the other third of all labelled candidates, which are scored and
    counted here. Without two classes there is nothing to learn and nothing is added.
    """
    mark = F.xxhash64("doc_id", "c.start", "c.stop")
    label = F.when(~F.col("c.f.formed"), 0.0).when(F.col("c.f.placed"), 1.0)
    each = rows.select("doc_id", F.explode("loose").alias("c")).select("c", mark.alias("mark"), label.alias("label"))
    each = each.where("label IS NOT NULL")
    sample = each.orderBy("mark", "c.start", "c.stop").limit(SAMPLE).select(
        "c", "label", F.pmod("mark", F.lit(3)).alias("fold"), *[F.col(f"c.f.{name}").alias(name) for name in FEATURES],
    )
    sample = settle(sample.coalesce(1))
    if sample.where("fold > 0").agg(F.count_distinct("label")).first()[0] < 2:
        return None, {}
    packed = VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(sample.where("fold > 0"))
    trees = GBTClassifier(
        maxIter=ROUNDS, maxDepth=DEPTH, minInstancesPerNode=LEAST, seed=1, labelCol="label"
    )
    sql = score_sql(trees.fit(packed.select("features", "label")))
    held = each.where(F.pmod("mark", F.lit(3)) == 0).select("c", "label")
    held = held.withColumn("score", F.expr(sql))
    cell = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("cell")
    table = held.groupBy(F.col("c.rank").alias("rank"), cell).agg(
        F.sum("label").alias("right"), F.count("*").alias("n")
    )
    thresholds = {}
    right, n, last = 0.0, 0, None
    for row in sorted(table.collect(), key=lambda r: (r["rank"], -r["cell"])):  # 5 * BINS at most
        if row["rank"] != last:
            right, n, last = 0.0, 0, row["rank"]
        right, n = right + row["right"], n + row["n"]
        if n >= LEAST and right >= PRECISION * n:
            thresholds[row["rank"]] = row["cell"] / BINS
    return sql, thresholds


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in ADDED_KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.rank], s.start, s.stop)), ',')")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    A null text is empty. Rows are handled one by one, repeated rows alike; other
    columns are not looked at. Spans are in code points, end exclusive.
    """
    rows = settle(candidates(docs))
    score, thresholds = learn(rows)
    added = "cast(array() AS array<struct<start:int,rank:int,stop:int>>)"
    if score and thresholds:
        limit = "CASE c.rank " + " ".join(f"WHEN {k} THEN {t}D" for k, t in thresholds.items()) + " ELSE 2D END"
        added = (
            "transform(filter(loose, c -> NOT c.touches AND c.f.formed AND c.f.letters_before = 0"
            f" AND c.f.letters_after = 0 AND {score} >= {limit}),"
            " c -> struct(c.start AS start, c.rank AS rank, c.stop AS stop))"
        )
    rows = rows.withColumn("added", F.expr(added)).withColumn(
        "all_spans", F.expr("array_sort(concat(base, added))")
    )
    counts = [
        F.expr(f"size(filter(base, s -> s.rank = {rank}))").cast("long").alias(f"n_{kind}")
        for rank, kind in enumerate(KINDS)
    ]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("all_spans").alias("spans"), F.size("added").cast("long").alias("n_added"),
        F.size("all_spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Replace the listed spans of ``text`` by [kind]; of overlapping ones the first stays."""
    text = (
        f"aggregate(filter(split({spans}, ','), x -> x <> ''), struct('' AS done, 0 AS at), (s, x) ->"
        " CASE WHEN int(split(x, ':')[1]) < s.at THEN s ELSE struct(concat(s.done,"
        " substring(text, s.at + 1, int(split(x, ':')[1]) - s.at), '[', split(x, ':')[0], ']') AS done,"
        " int(split(x, ':')[2]) AS at) END,"
        " s -> concat(s.done, substring(text, s.at + 1)))"
    )
    return docs.withColumn("text", F.expr(text))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(load(spark, sf_dir, "documents"))
