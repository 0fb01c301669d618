"""Secrets in texts: three fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A run of key characters is a secret if the log-likelihood ratio of the two is at least ``min_llr`` nats.
DataFrame functions only. Where a Java pattern matches, the pieces between its matches (``split``) and the matches
themselves (``regexp_extract_all``) give every position in code points. The models see what the patterns leave: their spans
are blanked out first, so what stands beside a span in one run of key characters is judged on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.arrays import running_sum


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = f"({'|'.join(map(_either, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``AKIA[A-Z0-9]+`` of 20 characters or more and ``[0-9a-f]+`` of 24 or more. Both take a whole run of their characters,
#: and what is left of a run that is too short is shorter still, so the least length can stand in the pattern. In ASSIGN it
#: can't: a value that is too short may itself be a keyword, and then takes that keyword away.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
#: A run this long is a candidate. Random keys are longer, and shorter runs carry too little evidence.
MIN_RUN = 16
#: Nats. Ordinary runs of 16 characters and more outnumber secrets by about e^7; the rest is the margin, for dates and paths.
MIN_LLR = 18.0
#: At most so many documents give the labelled samples, those first by a hash of doc_id; and so many digests are made.
SAMPLE_DOCS, SAMPLE_DIGESTS = 2000, 3000
MASK = "[SECRET]"
_CHUNK = 512
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost and not overlapping, as an array of (start, kind, end, value)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    starts = running_sum(F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("long")))
    befores = F.zip_with(starts, gaps, lambda s, g: s + F.length(g))
    spans = F.zip_with(
        befores, matches,
        lambda s, m: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")),
    )
    return F.when(text.rlike(pattern), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind; start and end in code points, end exclusive. Null: none."""
    text = F.coalesce(text, F.lit(""))
    long = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_ASSIGN
    assign = F.filter(_found(text, ASSIGN, "assign"), long)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, "access"), _found(text, HEX, "hex")))


def _numbers(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i, F.lit(1))))


def _steps(run: Column) -> Column:
    """Positions in the transition table of each character after the one before; 0 stands before the first."""
    numbers = _numbers(run)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(numbers, 1, F.length(run) - 1)), numbers, lambda a, b: a * (len(ALPHABET) + 1) + b)


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(run, random)``: runs of key characters with the label 1 for random strings and 0 for ordinary identifiers.

    Ordinary are the runs of eight characters or more outside the patterns' spans in at most SAMPLE_DOCS documents, and three
    words in a row there joined as in a program, a path or a constant; random are the spans' values there, and
    SAMPLE_DIGESTS digests spelled in hexadecimal, base 64 and capitals.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    some = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "_id")
    spans = some.select("t", F.transform(base_spans(F.col("t")), lambda s: s["value"]).alias("values"))
    secrets = spans.select(F.explode("values").alias("v")).select(F.element_at(F.regexp_extract_all("v", F.lit(RUN + "{8,}"), F.lit(0)), -1).alias("run"))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = some.select(F.explode(F.regexp_extract_all(masked, F.lit(RUN + "{8,}"), F.lit(0))).alias("run"))
    three = some.select(F.explode(F.regexp_extract_all(masked, F.lit("[a-z]{2,8} [a-z]{2,8} [a-z]{2,8}"), F.lit(0))).alias("w"))
    camel = F.regexp_replace(F.initcap("w"), " ", "")
    forms = [F.concat(F.lower(F.substring(camel, 1, 1)), F.expr("substring(replace(initcap(w), ' ', ''), 2)")), camel]
    forms += [F.translate("w", " ", c) for c in "_-/"] + [F.translate(F.upper("w"), " ", "_")]
    joined = three.select(F.element_at(F.array(*forms), (F.pmod(F.xxhash64("w"), F.lit(len(forms))) + 1).cast("int")).alias("run"))
    plain = plain.unionByName(joined)
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    made = spark.range(SAMPLE_DIGESTS).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.substring(coded, 1, 40), F.regexp_replace(F.upper(coded), "[^A-Z0-9]", ""))).alias("run")
    )
    random = secrets.where("run is not null").unionByName(made)
    return random.withColumn("random", F.lit(1)).unionByName(plain.withColumn("random", F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """The log of the ratio of both models' transition probabilities, by 68 * previous + next, add-one smoothed.

    Counted in Spark. The table has a fixed size, that of the alphabet squared.
    """
    steps = samples.where(F.length("run") > 0).select("random", F.explode(_steps(F.col("run"))).alias("step"))
    size = len(ALPHABET) + 1
    counts = [[1.0] * size * size for _ in range(2)]
    for label, step, n in steps.groupBy("random", "step").count().collect():
        counts[label][step] += n
    out = []
    for a in range(size):
        rows = [counts[k][a * size : (a + 1) * size] for k in range(2)]
        out += [math.log(r / sum(rows[1])) - math.log(o / sum(rows[0])) for o, r in zip(*rows, strict=True)]
    return out


def llr(run: Column, model: list[float]) -> Column:
    table = F.lit(model)
    return F.aggregate(_steps(run), F.lit(0.0), lambda total, step: total + F.element_at(table, step + 1))


def _blanked(text: Column) -> Column:
    """The text with blanks for the characters of assignments, and then of the other two patterns in what is left."""
    matches = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    gaps = F.split(text, ASSIGN, -1)
    blank = lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN, F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    text = F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(blank(m), F.lit("")))), "")
    # one character after the other, from where the pattern begins
    text = F.regexp_replace(text, f"(?:(?={ACCESS})|(?!^)\\G)[A-Z0-9]", " ")
    return F.regexp_replace(text, f"(?:(?<![0-9a-f])(?={HEX})|(?!^)\\G)[0-9a-f]", " ")


def all_spans(text: Column, base: Column, model: list[float], min_llr: float = MIN_LLR) -> Column:
    """``base`` and the runs that the models take for random in what the patterns leave, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    runs = _found(F.when(F.size(base) > 0, _blanked(text)).otherwise(text), RUN + f"{{{MIN_RUN},}}", "random")
    return F.array_sort(F.concat(base, F.filter(runs, lambda r: llr(r["value"], model) >= min_llr)))


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float], text: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``. Null and empty texts have none. No rows are dropped or joined."""
    with_base = docs.withColumn("base_spans", base_spans(F.col(text)))
    return with_base.withColumn("spans", all_spans(F.col(text), F.col("base_spans"), model, min_llr))


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch of overlapping spans replaced by ``mask``. Null stays null.

    Spans are gone through in chunks, each with its own piece of the text, so that the cost stays in proportion to the text.
    """

    def inside(piece: Column, base: Column, part: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, acc["at"] - base + 1, s["start"] - acc["at"])
            parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.array_join(F.aggregate(part, start, step)["parts"], "")

    def chunk(acc: Column, number: Column) -> Column:
        part = F.slice(spans, number * _CHUNK + 1, _CHUNK)
        stop = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        piece = F.substring(acc["rest"], F.lit(1), stop - acc["at"])
        return F.struct(
            stop.alias("at"), F.concat(acc["out"], inside(piece, acc["at"], part)).alias("out"),
            F.substring(acc["rest"], stop - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
        )

    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK).cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), text.alias("rest"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(numbers, start, chunk, lambda acc: F.concat(acc["out"], acc["rest"])))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with secrets masked. An empty table, and one whose texts are all null, comes back as it is."""
    model = train(labelled_samples(docs, doc_id, text))
    names = docs.columns
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(rest, model)
    clean = redacted(F.col("text"), F.col("spans"))
    return found.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text"), train(labelled_samples(docs)))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
