"""Personal data: candidate spans, boosted trees and calibrated redaction, with DataFrame functions alone.

Everything runs inside one row: generators find spans by pattern, the trees are
compiled to a SQL expression over a span's features, and no row is shuffled.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import only, table, text_of

#: Exact kinds, in their order, with their patterns. A run is entered at its start or where the last match ended, so that long runs cost one pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+){2}\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators of further spans.
FURTHER = {
    "number": r"\(?[0-9][0-9().\x20-]{5,}[0-9]",
    "bracketed": r"\([0-9]{2,5}\)\x20?[0-9]{2,5}(?:[-.\x20][0-9]{2,5})++",
    "grouped": r"(?<![0-9])[0-9]{3}([-.\x20])[0-9]{3}\1[0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]+)++",
}
KINDS = [*BASE, *FURTHER]
#: What a text must have, as a pattern, for a kind's pattern to be tried; a digit for the others.
NEEDS = {"email": "@", "phone": r"\+", "contact": r"[\[(](?:at|AT)[\])]"}
#: Words before a span that speak for a kind or against all.
CONTEXT = {
    "about_secret": r"(token|secret|passw|pwd|api.?key|key|auth|bearer)\W{0,6}$|(token|secret|password|key)\b",
    "about_phone": r"\b(tel|phone|call|fax|mobile|cell|dial|whatsapp)",
    "about_account": r"\b(card|visa|account|iban|ssn|social|passport|tax|licen[cs]e no)",
    "about_else": r"\b(order|version|release|page|pages|isbn|issn|date|year|total|chapter|figure|table|section|sha|commit|build|price|no|nr|vol|patent|serial)\b",
}
FEATURES = ["size", "digits", "letters", "capitals", "marks", "groups", "paren", "luhn", *CONTEXT, "hex", "quoted", "dots", "kind_code", "glued", "date", "longest"]
TRAINING_TEXTS = 3000
PRECISION = 0.98


def find_spans(df: DataFrame, kind: str, pattern: str, out: str) -> DataFrame:
    """Add ``out``: the pattern's leftmost non-overlapping matches in ``text`` as array of (start, end, match).

    Places count code points, ends are exclusive. They come from the lengths of
    the matches and of what lies between them.
    """
    literal = F.lit(pattern)
    may = F.rlike("text", F.lit(NEEDS.get(kind, "[0-9]")))
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all("text", literal, F.lit(0))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", literal, -1)))
    starts = F.expr("""aggregate(sequence(0, size(_m) - 1), named_struct('at', 0, 'out', cast(array() as array<int>)), (s, i) -> named_struct(
        'at', s.at + length(get(_p, i)) + length(get(_m, i)), 'out', concat(s.out, array(s.at + length(get(_p, i))))), s -> s.out)""")
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.when(F.size("_p") == F.size("_m") + 1, starts).otherwise(F.raise_error(F.lit(f"matches and gaps of {kind} differ in number")))))
    spans = F.expr("transform(_m, (m, i) -> named_struct('start', get(_s, i), 'end', get(_s, i) + length(m), 'match', m))")
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return df.withColumn(out, F.when(F.coalesce(F.size("_s"), F.lit(0)) > 0, spans).otherwise(none)).drop("_m", "_p", "_s")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds; doubles every second digit from the right."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    digit = lambda i: F.coalesce(F.try_to_number(F.substring(F.reverse(digits), i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(at, F.lit(0), lambda n, i: n + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = digits_of(x["match"])
    if kind == "ip":
        return F.forall(F.split(x["match"], r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) < 4) & F.forall(F.split(x["match"], r"\."), lambda part: F.right(F.concat(F.lit("000"), part), F.lit(3)) <= "255")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _ranked(kind: str, rank: int) -> Column:
    valid = F.filter(f"_{kind}", lambda x: _valid(kind, x))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def base_spans(df: DataFrame) -> DataFrame:
    """Add ``base``: exact spans as array of (start, rank, end) in order of start and then kind."""
    for kind, pattern in BASE.items():
        df = find_spans(df, kind, pattern, f"_{kind}")
    ranked = [_ranked(kind, rank) for rank, kind in enumerate(BASE)]
    return df.withColumn("base", F.array_sort(F.concat(*ranked))).drop(*[f"_{kind}" for kind in BASE])


def candidates(df: DataFrame) -> DataFrame:
    """Add ``candidates``: spans of the further generators with their features."""
    for kind, pattern in FURTHER.items():
        df = find_spans(df, kind, pattern, f"_{kind}")
    count = lambda text, pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    is_ = lambda c: F.when(c, 1.0).otherwise(0.0)

    def described(rank: int):
        return lambda x: features(x, rank)

    def features(x: Column, rank: int) -> Column:
        match, start = x["match"], x["start"]
        before = F.lower(F.substring(F.col("text"), F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24))))
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            x["end"].alias("end"),
            F.length(match).cast("double").alias("size"),
            count(match, "[0-9]").alias("digits"),
            count(match, "[A-Za-z]").alias("letters"),
            count(match, "[A-Z]").alias("capitals"),
            count(match, "[^A-Za-z0-9]").alias("marks"),
            F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))).cast("double").alias("groups"),
            is_(F.contains(match, F.lit("("))).alias("paren"),
            is_(luhn(digits_of(match))).alias("luhn"),
            *[is_(F.rlike(before, F.lit(pattern))).alias(name) for name, pattern in CONTEXT.items()],
            is_(F.rlike(match, F.lit("^[0-9a-fA-F]+$"))).alias("hex"),
            is_(F.rlike(before, F.lit("[\"']$"))).alias("quoted"),
            count(match, "[.]").alias("dots"),
            F.lit(float(rank)).alias("kind_code"),
            is_(F.rlike(before, F.lit("[a-z0-9]$"))).alias("glued"),
            is_(F.rlike(match, F.lit(r"^(19|20)\d\d[-. ](0?[1-9]|1[0-2])[-. ]|[-. ](19|20)\d\d$"))).alias("date"),
            F.array_max(F.transform(F.split(match, "[^0-9]"), lambda g: F.length(g))).cast("double").alias("longest"),
        )

    parts = [F.transform(f"_{kind}", described(len(BASE) + k)) for k, kind in enumerate(FURTHER)]
    return df.withColumn("candidates", F.concat(*parts)).drop(*[f"_{kind}" for kind in FURTHER])


def training_texts(n: int = TRAINING_TEXTS, seed: int = 23) -> list[tuple[str, int, int, int]]:
    """Made-up texts with one span each: text, start, end, and whether the span is private."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    opaque = lambda k, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(k))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sep = lambda: rng.choice(["-", " ", "."])

    def grouped(sizes: list[int]) -> str:
        mark = sep()
        return mark.join(number(k) for k in sizes)

    private = [
        lambda: (rng.choice(['token = "', "api_key: ", 'secret="', "password=", "auth token ", "key = '"]), opaque(rng.choice([20, 32, 40, 64]))),
        lambda: (rng.choice(['token = "', "api key ", "secret: ", "bearer "]), opaque(rng.randint(16, 48), wide)),
        lambda: (rng.choice(["", "call ", "phone ", "tel. ", "reach me on "]), f"({number(3)}) {number(3)}-{number(4)}"),
        lambda: (rng.choice(["", "call ", "phone ", "fax ", "mobile "]), grouped([3, 3, 4])),
        lambda: (rng.choice(["ssn ", "social security ", ""]), f"{number(3)}-{number(2)}-{number(4)}"),
        lambda: (rng.choice(["", "card ", "visa ", "account ", "paid with "]), rng.choice([number(16), grouped([4, 4, 4, 4]), number(15)])),
        lambda: (rng.choice(["iban ", "", "account "]), opaque(2, wide[:26]) + number(2) + opaque(4, wide[:26]) + number(14)),
        lambda: (rng.choice(["write to ", "", "mail "]), f"{opaque(6, wide[26:52])} {rng.choice(['(at)', '[at]'])} {opaque(5, wide[26:52])} {rng.choice(['(dot)', '.', '[dot]'])} com"),
    ]
    other = [
        lambda: (rng.choice(["order ", "no ", "patent ", "serial ", ""]), number(rng.randint(7, 8))),
        lambda: (rng.choice(["on ", "date ", ""]), rng.choice([f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)}"])),
        lambda: (rng.choice(["pages ", "years ", ""]), f"{rng.randint(1000, 2030)}-{rng.randint(1000, 2030)}"),
        lambda: (rng.choice(["version ", "release ", "build "]), ".".join(number(rng.randint(1, 4)) for _ in range(rng.randint(4, 6)))),
        lambda: (rng.choice(["about ", "total ", ""]), f"{number(1)}.{number(rng.randint(6, 9))}"),
        lambda: (rng.choice(["isbn ", "issn "]), rng.choice([f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(4)}-{number(4)}"])),
        lambda: (rng.choice(["sha ", "commit ", "build "]), opaque(40)),
        lambda: (rng.choice(["", "see ", "page "]), "-".join(opaque(rng.randint(4, 9), wide[26:52]) for _ in range(3)) + "-" + number(2)),
        lambda: (rng.choice(["", "row "]), " ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(5, 9)))),
    ]
    out = []
    for k in range(n):
        label = k % 2
        lead, span = rng.choice(private if label else other)()
        words = [" ".join(opaque(rng.randint(2, 8), wide[26:52]) for _ in range(rng.randint(1, 6))) for _ in range(2)]
        head = f"{words[0]} {lead}"
        out.append((head + span + ('"' if lead.endswith('"') else "") + f" {words[1]}", len(head), len(head) + len(span), label))
    return out


def tree_sql(node, features: list[str]) -> str:
    """A fitted tree as a SQL expression over the fields of the span ``x``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction())) + "D"
    split = node.split()
    left, right = tree_sql(node.leftChild(), features), tree_sql(node.rightChild(), features)
    return f"if(x.{features[split.featureIndex()]} <= {float(split.threshold())!r}D, {left}, {right})"


def fit_selector(spark: SparkSession, trees: int = 12, depth: int = 4) -> tuple[str, float]:
    """(SQL of a span's probability, threshold): boosted trees fitted on made-up texts.

    The threshold is the lowest with a precision of PRECISION on the third of
    the texts that the fit has not seen.
    """
    texts = spark.createDataFrame(training_texts(), "text string, a int, b int, label int").coalesce(1)
    spans = candidates(texts).select("text", "a", "b", "label", F.explode("candidates").alias("x"))
    shared = F.least(F.col("x.end"), F.col("b")) - F.greatest(F.col("x.start"), F.col("a"))  # a span is right if this is half of what either covers
    rows = spans.select((F.col("label") * (2 * shared >= F.greatest(F.col("x.end"), F.col("b")) - F.least(F.col("x.start"), F.col("a"))).cast("int")).cast("double").alias("label"), F.pmod(F.crc32(F.encode("text", "UTF-8")), F.lit(3)).alias("part"), *[F.col(f"x.{f}").alias(f) for f in FEATURES])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "part", "features").cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3).fit(rows.where("part < 2"))
    score = " + ".join(f"{w!r}D * {tree_sql(t._call_java('rootNode'), FEATURES)}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    held = model.transform(rows.where("part = 2"))
    judged = sorted(((r["probability"][1], r["label"]) for r in held.select("probability", "label").collect()), reverse=True)  # a third of TRAINING_TEXTS
    rows.unpersist()
    threshold, right = 1.0, 0
    for k, (p, label) in enumerate(judged, 1):
        right += label
        if right / k >= PRECISION and p > 0.5:
            threshold = p
    return f"1 / (1 + exp(-2 * ({score})))", threshold


def detect(docs: DataFrame, selector: tuple[str, float] | None = None) -> DataFrame:
    """``docs``, all columns, with ``base`` and ``spans``: arrays of (start, rank, end).

    rank is the place of the kind in KINDS. ``spans`` has all of ``base`` and
    the candidates whose calibrated score reaches the threshold, unless they
    overlap one of ``base`` or a better candidate. A null or empty text has none.
    Rows are judged one by one, so repeated ones alike and an empty table gives
    none; input columns called base or spans are replaced. The work on one text
    grows with the square of its spans.
    """
    score, threshold = selector or fit_selector(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    df = docs.select(*[F.col(f"`{c}`").alias(f"_in_{k}") for k, c in enumerate(names)], F.col("text").alias("_text"), text_of().alias("text"))
    df = candidates(base_spans(df))
    scored = F.expr(f"transform(candidates, x -> named_struct('score', {score}, 'start', x.start, 'rank', x.rank, 'end', x.end))")
    df = df.withColumn("_scored", F.when(F.size("candidates") > 0, scored))
    chosen = F.filter("_scored", lambda x: (x["score"] >= threshold) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn("_chosen", F.when(F.size("_scored") > 0, F.reverse(F.array_sort(chosen))))
    picked = F.expr("""aggregate(_chosen, cast(array() as array<struct<start:int,rank:int,end:int>>), (kept, x) ->
        if(exists(kept, k -> k.start < x.end and x.start < k.end), kept, concat(kept, array(named_struct('start', x.start, 'rank', x.rank, 'end', x.end)))))""")
    df = df.withColumn("spans", F.when(F.coalesce(F.size("_chosen"), F.lit(0)) > 0, F.array_sort(F.concat("base", picked))).otherwise(F.col("base")))
    own = [F.col(f"_in_{names.index(c)}").alias(c) if c != "text" else F.col("_text").alias("text") for c in docs.columns if c not in ("base", "spans")]
    return df.select(*own, "base", "spans")


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, selector: tuple[str, float] | None = None) -> DataFrame:
    """``docs``, all columns, with each span of ``text`` replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null, and so do all other columns what they are.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = detect(inner, selector)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(F.when(x["start"] < s["at"], s["done"]).otherwise(F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.get(names, x["rank"]))).alias("done"), x["end"].alias("at"))
    )
    clean = F.aggregate("spans", state, step, lambda s: F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    out = found.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return out.select(*[F.col("_clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    of = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select("doc_id", *[of(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
