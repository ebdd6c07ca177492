"""Secret scans (operator 6). DataFrame functions only.

Three fixed patterns find assignments, access keys and long hex runs. Character
Markov models add the runs of token characters that a model of random strings
explains better than ordinary ones do, of which there are two, one of
identifiers and one of id forms. Against each of them the sum over adjacent characters of the
log-likelihood ratio must pass a threshold for each character, over the run or
over a segment of it, so that words glued to a secret don't hide it. Such a run
is a span as a whole, also where a pattern found a part.

The models are trained from labelled samples: random strings are digests of
numbers up to TRAIN_RANDOM, written in four alphabets. Identifiers are paths,
names in camel, snake and kebab case, with numbers and without, of common words
and of the words of well-known licences, and those of a bounded sample of
the given documents; both weigh alike. Id forms are UUIDs, bases of DNA, dates, numbered parts
and versions. What comes to the driver are matrices of a fixed size.

Positions are code points, ends are exclusive. Null and empty texts have no
spans. Repeated rows give repeated results; no row meets another, so nothing
is shuffled, and texts are scanned whole. Of an empty table the models are
trained on random strings alone and no row is scored. Extra columns are
ignored by scan() and kept by redact().
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licenses import TEMPLATES

#: The fixed patterns, in the order in which spans that start together are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Runs that the models judge. Shorter ones say too little.
RUN_LEAST = 16
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}+"
KINDS = ("assign", "access", "hex", "random")
#: Characters that the models know; any other counts as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents whose words train the model of identifiers, random strings in each alphabet, and identifiers and id forms that are made.
TRAIN_DOCUMENTS, TRAIN_RANDOM, TRAIN_MADE = 1000, 2000, 12_000
#: Pairs of characters that each sample of identifiers counts as, so that neither drowns the other.
PAIRS = 200_000
#: A run or a segment of it is random if its log-likelihood ratio is above this for each character, against identifiers and against id forms.
THRESHOLDS = (0.6, 0.3)

#: Common words of identifiers (fixed values).
COMMON = (
    "abstract access account action address admin agent api app archive array async attribute audit author backup base batch bean beta binary block boolean branch buffer "
    "build bundle button cache callback cell channel check child class clean client clone cloud cluster code column command common component config connect console "
    "container content context control cookie copy core count create cursor data database date debug default delete deploy device dialog directory document domain "
    "download driver dynamic edge editor element email engine entity error event example exception execute export expression factory feature field file filter final "
    "flag folder format frame function gateway generator global graph group handle hash header height helper history home hook host html icon image import index inner "
    "input instance interface internal item iterator java job json kernel key label layer layout library limit line linux list listener local lock login machine main"
).split()

#: Matches of a text that are placed one after the other.
BLOCK = 256

_SPAN = "array<struct<start: long, rank: int, end: long>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Where a pattern's leftmost non-overlapping matches stand. keep: of a match's string, whether it counts."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the text between has one part more than there are matches
    steps = F.zip_with(
        between,
        found,
        lambda b, m: F.struct(
            F.char_length(b).alias("gap"),
            F.coalesce(F.char_length(m), F.lit(0)).alias("size"),
            F.coalesce(keep(m) if keep else m.isNotNull(), F.lit(False)).alias("keep"),
        ),
    )

    return F.when(text.rlike(pattern), _placed(steps, rank)).otherwise(_none())


def _placed(steps: Column, rank: int) -> Column:
    """The spans of steps of array<struct<gap, size, keep>>.

    Each place is the sum of all before it. An array that a fold appends to is copied each time, so steps are added up in
    blocks of BLOCK, and each block then begins where the ones before it end.
    """
    block = lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK))
    zero = F.lit(0).cast("long")
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    lengths = F.transform(blocks, lambda k: F.aggregate(block(k), zero, lambda n, x: n + x["gap"] + x["size"]))
    begins = F.aggregate(lengths, F.array(zero), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["keep"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    told = lambda k: F.aggregate(block(k), F.struct(F.get(begins, k).alias("at"), _none().alias("spans")), add, lambda acc: acc["spans"])
    return F.flatten(F.transform(blocks, told))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns: array<struct<start, rank, end>>, sorted."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, value), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _place(c: Column) -> Column:
    """A character's place in the alphabet from 1; 0 for others."""
    return F.instr(F.lit(ALPHABET), c)


def _pairs(words: DataFrame) -> DataFrame:
    """(a, b, n): how often one character follows another in the strings of column word."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    # each distinct pair is looked up once, after counting
    counted = each.groupBy("pair").agg(F.count("*").alias("n"))
    return counted.groupBy(_place(F.substring("pair", 1, 1)).alias("a"), _place(F.substring("pair", 2, 1)).alias("b")).agg(F.sum("n").alias("n"))


def random_strings(spark: SparkSession, first: int = 0, count: int = TRAIN_RANDOM) -> DataFrame:
    """The sample labelled random: digests of numbers in hex, base 64, capitals with digits, and letters with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    rows = spark.range(first, first + count).select(
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                base64,
                F.regexp_replace(F.upper(F.base64(F.unhex(F.sha2(digest, 256)))), "[+/=]", ""),
                F.regexp_replace(F.base64(F.unhex(F.sha2(base64, 256))), "[+/=]", ""),
            )
        ).alias("word")
    )
    return rows


def _picked(words: list[str], seed: int) -> Column:
    """A word of the list for each id."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(words))) + 1).cast("int"))


def common_identifiers(spark: SparkSession, count: int = TRAIN_MADE) -> DataFrame:
    """The sample labelled identifiers, as programs and file systems have them."""
    english = sorted({w.lower() for _, text in TEMPLATES for w in re.findall("[A-Za-z]{2,}", text)})
    a, b, c = (F.when(F.col("id") % 3 == 0, _picked(english, k)).otherwise(_picked(COMMON, k)) for k in range(3))
    n = _picked(["", "", "2", "3", "8", "64"], 3)
    forms = [
        F.concat(F.initcap(a), F.initcap(b), F.initcap(c), n),
        F.concat_ws("_", a, F.concat(b, n), c),
        F.concat_ws("/", a, b, c),
        F.concat(F.upper(a), F.lit("-"), F.upper(b), n, F.lit("_"), F.upper(c)),
        F.concat(a, F.initcap(b), n),
        F.concat(F.concat_ws("-", a, b, c), n),
    ]
    return spark.range(count).select(F.element_at(F.array(*forms), (F.floor(F.col("id") / 3) % len(forms) + 1).cast("int")).alias("word"))


def id_forms(spark: SparkSession, count: int = TRAIN_MADE) -> DataFrame:
    """The sample labelled id forms: ordinary strings of letters and digits that aren't made of words alone."""
    h = F.sha2(F.concat(F.lit("id"), F.col("id").cast("string")), 256)
    number = lambda at, below: (F.conv(F.substring(h, at, 7), 16, 10).cast("long") % below).cast("int")
    date = [2000 + number(1, 30), 1 + number(9, 12), 1 + number(17, 28)]
    a, b = _picked(COMMON, 4), _picked(COMMON, 5)
    forms = [
        F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.translate(F.substring(h, 1, 40), "0123456789abcdef", "ACGTACGTACGTACGT"),
        F.format_string("%04d%02d%02d_%06d", *date, number(25, 10**6)),
        F.format_string("%04d-%02d-%02d/%d", *date, number(25, 10**7)),
        F.format_string("%s_%04d%02d%02d_%06d_%s", F.upper(a), *date, number(25, 10**6), F.upper(b)),
        F.format_string("%s-%04d-%02d-%02d-%d", a, *date, number(25, 1000)),
        F.format_string("%s/%s_%05d-of-%05d", a, b, number(25, 10**5), number(33, 10**5)),
        F.format_string("%s_%d-%d-%d_%s", a, number(25, 100), number(33, 10), number(41, 10), b),
    ]
    return spark.range(count).select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("word"))


def ordinary_strings(docs: DataFrame) -> DataFrame:
    """The sample labelled ordinary: words of at most TRAIN_DOCUMENTS documents, and identifiers of neighbouring words."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("chosen")).where("chosen is not null").distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(TRAIN_DOCUMENTS)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("chosen"),
        F.col("text").cast("string").alias("text"),
    ).join(F.broadcast(chosen), "chosen", "left_semi")
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    near = texts.select(words.alias("w")).where(F.size("w") > 1)
    joined = F.transform(F.slice("w", 2, F.size("w") - 1), lambda b, i: F.struct(F.get(F.col("w"), i).alias("a"), b.alias("b"), (i % 4).alias("k")))
    a, b, k = F.col("x.a"), F.col("x.b"), F.col("x.k")
    identifier = F.when(k == 0, F.concat(a, b)).when(k == 1, F.concat(F.lower(a), F.lit("_"), F.lower(b))).when(
        k == 2,
        F.concat(F.lower(a), F.initcap(b), F.lit("2")),
    ).otherwise(F.concat(F.upper(a), F.lit("-"), F.upper(b)))
    return near.select(F.explode(joined).alias("x")).select(identifier.alias("word"))


def train(docs: DataFrame) -> list[list[float]]:
    """The log-likelihood ratios of adjacent characters, row by row: of random strings against identifiers, and against id forms."""
    size, spark = len(ALPHABET) + 1, docs.sparkSession
    samples = [random_strings(spark), common_identifiers(spark), ordinary_strings(docs), id_forms(spark)]
    counted = None
    for kind, words in enumerate(samples):
        own = _pairs(words).withColumn("kind", F.lit(kind))
        counted = own if counted is None else counted.unionAll(own)
    found = [[0.0] * size * size for _ in samples]
    for a, b, count, kind in counted.collect():  # at most 4 * size * size rows
        found[kind][a * size + b] += count
    alike = [[n * PAIRS / (sum(own) or 1) for n in own] for own in found[1:3]]
    identifiers = [x + y for x, y in zip(*alike)]

    def logs(own: list[float]) -> list[float]:
        rows = [[n + 0.5 for n in own[a * size : (a + 1) * size]] for a in range(size)]
        return [math.log(n / sum(row)) for row in rows for n in row]

    random, against = logs(found[0]), [logs(identifiers), logs(found[3])]
    return [[r - o for r, o in zip(random, own)] for own in against]


def random_like(word: Column, model: list[list[float]]) -> Column:
    """Whether the random model explains a string better than either ordinary one."""
    identifiers, ids = (_better(word, ratios, least) for ratios, least in zip(model, THRESHOLDS))
    return identifiers & ids


def _better(word: Column, given: list[float], threshold: float) -> Column:
    """Whether the random model explains a string, or a best-scoring segment of it, better than another by a threshold a character.

    A segment counts if it is as long as a run must be. Next to ordinary words numbers say nothing: within segments
    the ratio of two characters of which neither is a letter counts as 0.
    """
    size, ratios = len(ALPHABET) + 1, F.lit(given)
    places = F.transform(F.split(word, ""), _place)
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("sum"),
        F.lit(-1).alias("before"),
        zero.alias("gain"),
        F.lit(0).alias("length"),
        zero.alias("most"),
        F.lit(False).alias("found"),
    )
    letter = lambda p: (p >= 1) & (p <= 52)

    # folds that carry the character before, so a long run takes time in proportion to its length
    def ratio(s: Column, b: Column) -> Column:
        r = F.when(s["before"] < 0, 0.0).otherwise(F.get(ratios, s["before"] * size + b))
        own = F.when(letter(s["before"]) | letter(b), r).otherwise(0.0)
        return F.struct(s.alias("s"), b.alias("b"), r.alias("r"), (s["gain"] + own - threshold).alias("gain"))

    def add(x: Column) -> Column:
        s, gain, length = x["s"], x["gain"], x["s"]["length"] + 1
        up = (gain > 0) & (s["before"] >= 0)
        return F.struct(
            (s["sum"] + x["r"]).alias("sum"),
            x["b"].alias("before"),
            F.when(up, gain).otherwise(0.0).alias("gain"),
            F.when(up, length).otherwise(0).alias("length"),
            F.when(up, F.greatest(s["most"], gain)).otherwise(0.0).alias("most"),
            # length counts pairs; a segment ends where its sum is the most since it began
            (s["found"] | (up & (gain > s["most"]) & (length >= RUN_LEAST - 1))).alias("found"),
        )

    step = lambda s, b: F.element_at(F.transform(F.array(ratio(s, b)), add), 1)
    return F.aggregate(places, start, step, lambda s: (s["sum"] > threshold * F.char_length(word)) | s["found"])


def random_spans(text: Column, model: list[list[float]]) -> Column:
    """Whole runs that the models take for random, or a segment of them. Runs of digits alone are numbers, not secrets."""
    judged = lambda m: ~m.rlike("^[0-9+/_=-]+$") & random_like(m, model)
    return _spans(text, RUN, 3, judged)


def with_spans(docs: DataFrame, model: list[list[float]], text: Column) -> DataFrame:
    """docs with columns base_found and all_found: spans of the fixed patterns, and all. Random spans within one of the former are left out."""
    base = docs.withColumn("base_found", base_spans(text))
    more = F.filter(random_spans(text, model), lambda r: ~F.exists("base_found", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return base.withColumn("all_found", F.array_sort(F.concat("base_found", more)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[list[float]] | None = None) -> DataFrame:
    """(doc_id, base_found, all_found) of every document."""
    model = train(docs) if model is None else model
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_spans(own, model, F.col("text")).drop("text")


def redacted(text: Column, spans: Column, instead: str = "[SECRET]") -> Column:
    """text with sorted spans, overlapping ones together, replaced."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(instead))).otherwise(acc["out"]).alias("out"),
        )

    whole = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, model: list[list[float]] | None = None, instead: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced; n_chars, if there, follows. Null texts stay null."""
    model = train(docs) if model is None else model
    columns = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(boxed, model, F.col("text"))
    clean = found.select(
        "row",
        (F.size("all_found") > 0).alias("changed"),
        F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(redacted(F.col("text"), F.col("all_found"), instead)).alias("clean"),
    )
    kinds = dict(docs.dtypes)
    new = {"text": F.col("clean").cast(kinds["text"])}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("changed"), F.char_length("clean").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return clean.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts of the fixed patterns, their digest, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base_found", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base_found")), 256).alias("base_sha256"),
        written(F.col("all_found")).alias("spans"),
    )
