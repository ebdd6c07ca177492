"""Quality rules: tokeniser fertility with rejection bands per language and script (operator 5).

A public vocabulary with byte fallback measures each text: characters per
token, the share of tokens that are single fallback bytes, and the entropy of
the token distribution. Texts that fail the plain counts (too few words, or
mostly repeated three-word windows) are rejected. So are those whose measures
leave a band:

* a wide one of the text's main script, which is fixed: how far the vocabulary
  spells that script in bytes bounds the share of bytes, and texts of symbols
  have a strict band;
* a narrower one fitted to the table, for each script and each language within
  it: the quartiles of a measure less or more LOW or HIGH times what lies
  between them. The ends for n different texts weigh n against the PRIOR
  of the wider ends, the script's for a language and the fixed ones for a
  script, so few texts move a band little and no number of them switches it.

Quartiles come from histograms of all texts that pass the plain counts, each
different set of measures counted once, so exact copies have no weight.

Words are cut at blanks and tokenised one by one, which is how such
vocabularies see them; every distinct word is tokenised once per worker and
remembered in a bounded cache. A text is measured whole, however long it is, and
once: measures are written to the shared folder before bands are fitted to them.

Null, empty and blank texts have no words, all counts zero, and fail the plain
counts; their measures are zero. Null languages have the script's band. Repeated
rows give repeated results. Without texts to fit on only the fixed bands hold.
Extra columns are ignored by measure() and kept by keep().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpointed, table, text_slices, vocabulary_bytes, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Fewest words of a kept text; largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Distinct words that a worker remembers before it starts afresh, and bytes of text that it measures at a time.
REMEMBER, SLICE = 120_000, 2 << 20


@dataclass(frozen=True)
class Band:
    """What a kept text may measure; both ends are included."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    max_entropy: float


#: First code point of ranges and the script that each belongs to. "spelled" are scripts that vocabularies mostly spell in bytes.
SCRIPT_STARTS = {
    0x41: "latin", 0x370: "greek", 0x400: "cyrillic", 0x530: "armenian", 0x590: "hebrew", 0x600: "arabic", 0x780: "spelled", 0x900: "indic",
    0xE00: "thai", 0xE80: "spelled", 0x10A0: "georgian", 0x1100: "hangul", 0x1200: "spelled", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "symbols",
    0x3040: "kana", 0x3100: "symbols", 0x3400: "han", 0xA000: "spelled", 0xAC00: "hangul", 0xD7B0: "symbols", 0xF900: "han", 0xFB00: "symbols",
}
_STARTS = np.array(list(SCRIPT_STARTS), dtype=np.uint32)
_NAMES = list(SCRIPT_STARTS.values())

#: Fixed bands per main script: plain sentences in these scripts measure well inside, random code points of them outside.
BANDS = {
    "latin": Band(1.2, 8.0, 0.05, 4.0, 14.0),
    "greek": Band(0.6, 8.0, 0.1, 3.0, 14.0),
    "cyrillic": Band(0.8, 8.0, 0.1, 3.0, 14.0),
    "armenian": Band(0.5, 8.0, 0.4, 3.0, 14.0),
    "hebrew": Band(0.6, 8.0, 0.15, 3.0, 14.0),
    "arabic": Band(0.6, 8.0, 0.15, 3.0, 14.0),
    "indic": Band(0.45, 8.0, 0.5, 3.0, 14.0),
    "thai": Band(0.6, 8.0, 0.2, 3.0, 14.0),
    "georgian": Band(0.5, 8.0, 0.2, 3.0, 14.0),
    "han": Band(0.45, 8.0, 0.5, 3.0, 14.0),
    "kana": Band(0.5, 8.0, 0.4, 3.0, 14.0),
    "hangul": Band(0.45, 8.0, 0.4, 3.0, 14.0),
    "spelled": Band(0.25, 8.0, 0.95, 2.5, 14.0),
    "symbols": Band(0.6, 8.0, 0.1, 4.0, 14.0),
}

#: Fitted bands: how many times the distance of the quartiles lies below and above them, and what that distance is at least,
#: as a share of their mean or, for the share of bytes, as it is.
LOW, HIGH, LEAST_SPREAD, LEAST_BYTES = 2.0, 3.0, 0.03, 0.02
#: How many texts the wider ends of a band count as when it is fitted.
PRIOR = 20
#: Width of a bin of the histograms.
STEPS = {"chars_per_token": 0.01, "byte_share": 0.001, "token_entropy": 0.01}
#: Languages and scripts up to which their bands are broadcast.
BROADCAST_ROWS = 100_000


def script_of(text: str) -> str:
    """The script most letters of a text are in; ties go to the one with the earliest range."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = points[points >= 0x41]
    counts = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1, minlength=len(_NAMES))
    total: dict[str, int] = {}
    for name, n in zip(_NAMES, counts.tolist()):
        total[name] = total.get(name, 0) + n
    return max(total, key=total.get)


class Fertility:
    """Tokenises words once and measures texts from what it remembers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._is_byte = np.array([self._sp.is_byte(i) for i in range(self._sp.vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._chars = np.zeros(0, dtype=np.int64)
        self._start = np.zeros(1, dtype=np.int64)
        self._tokens = np.zeros(0, dtype=np.int32)

    def learn(self, texts: list[list[str]]) -> None:
        """Tokenises the words of some texts that aren't known yet, all at once."""
        new = set().union(*texts).difference(self._at)
        if len(self._at) + len(new) > REMEMBER and self._at:
            self._forget()
            new = set().union(*texts)
        if new:
            words = list(new)
            ids = self._sp.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self._at.update(zip(words, range(len(self._at), len(self._at) + len(words))))
            self._chars = np.concatenate([self._chars, np.fromiter(map(len, words), dtype=np.int64, count=len(words))])
            self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(sizes)])
            self._tokens = np.concatenate([self._tokens, np.fromiter(chain.from_iterable(ids), dtype=np.int32)])

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """The measures of each text, in order."""
        words = [WORD.findall(t or "") for t in texts]
        self.learn(words)
        return map(self._measure, [t or "" for t in texts], words)

    def _measure(self, text: str, words: list[str]) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, n_bytes, entropy in bits."""
        n = len(words)
        symbols = sum(map(text.count, SYMBOLS))
        if not n:
            return 0, 0, symbols, 0, 0, 0, 0, 0.0
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        at = np.fromiter(map(self._at.__getitem__, words), dtype=np.int64, count=n)
        kinds, local, counts = np.unique(at, return_inverse=True, return_counts=True)
        sizes = self._start[kinds + 1] - self._start[kinds]
        ends = np.cumsum(sizes)
        tokens = self._tokens[np.arange(ends[-1]) + np.repeat(self._start[kinds] - ends + sizes, sizes)]
        times = np.repeat(counts, sizes)
        used, where = np.unique(tokens, return_inverse=True)
        each = np.bincount(where, weights=times)
        total = each.sum()
        entropy = float(np.log2(total) - (each * np.log2(each)).sum() / total)
        return n, int(self._chars[at].sum()), symbols, len(lines) - len(set(lines)), repeated(local, len(kinds)), int(total), int(times[self._is_byte[tokens]].sum()), entropy


def repeated(ids: np.ndarray, kinds: int) -> int:
    """How many words lie in windows of WINDOW words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = ids[: n + WINDOW - 1].astype(np.int64)
    windows = key[:n]
    for k in range(1, WINDOW):
        if k > 1 and kinds > 1 << 20:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * kinds + key[k : k + n]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + n] |= hit
    return int(covered.sum())


_READY: dict[int, Fertility] = {}


def _ready(sent) -> Fertility:
    key = hash(sent.value)
    if key not in _READY:
        _READY[key] = Fertility(sent.value)
    return _READY[key]


def _send(spark: SparkSession, vocabulary: str | None):
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64()] + [pa.float64()] * 3


def measured(docs: DataFrame, kept: Column, vocabulary: str | None = None) -> DataFrame:
    """A kept column, lang, and the counts and measures of every document row, written down.

    If the kept column is a whole row its text is taken from there, so that a text travels once.
    """
    sent = _send(docs.sparkSession, vocabulary)
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(lang.alias("lang"), kept)
    name = own.columns[1]
    whole = name == "row"
    if not whole:
        own = docs.select(lang.alias("lang"), kept, docs["text"].cast("string").alias("text"))

    def text_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(name).field("text").cast(pa.string()) if whole else batch.column("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _ready(sent)
        for batch in text_slices(batches, SLICE, text_of):
            texts, out = text_of(batch).to_pylist(), []
            for text, (n, chars, symbols, dup, rep, tokens, n_bytes, entropy) in zip(texts, fertility.rows(texts)):
                failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
                out.append((n, chars, symbols, dup, rep, failed, script_of(text or ""), tokens, chars / max(1, tokens), n_bytes / max(1, tokens), entropy))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*out), _KINDS))], names)

    schema = StructType(own.schema.fields[:2] + StructType.fromDDL(_MEASURES).fields)
    names = schema.names
    return written(own.mapInArrow(run, schema))


def fixed_bands(spark: SparkSession) -> DataFrame:
    """(script, <measure>_lo, <measure>_hi) of BANDS."""
    ends = lambda b: ((b.min_chars_per_token, b.max_chars_per_token), (0.0, b.max_byte_share), (b.min_entropy, b.max_entropy))
    rows = [F.struct(F.lit(k).alias("script"), *[F.lit(x).alias(f"{m}_{e}") for m, own in zip(STEPS, ends(b)) for e, x in zip(("lo", "hi"), own)]) for k, b in BANDS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def _towards(own: DataFrame, wider: DataFrame) -> DataFrame:
    """own with its ends drawn to those of its script in wider, which count as PRIOR texts."""
    ends = [f"{m}_{e}" for m in STEPS for e in ("lo", "hi")]
    met = own.join(F.broadcast(wider.select("script", *[F.col(c).alias(f"_{c}") for c in ends])), "script")  # scripts are few
    return met.select("script", "lang", *[((F.col("n") * F.col(c) + PRIOR * F.col(f"_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in ends])


def fitted_bands(found: DataFrame) -> DataFrame:
    """(script, lang, <measure>_lo, <measure>_hi): fitted bands of languages and, with a null lang, of scripts."""
    kinds = found.where("NOT base_failed").select("script", "lang", "n_words", "n_tokens", *STEPS).distinct()
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / step).alias("bin")) for m, step in STEPS.items()])
    each = kinds.select("script", F.explode(F.array_distinct(F.array("lang", F.lit(None).cast("string")))).alias("lang"), values.alias("v"))
    bins = each.select("script", "lang", F.explode("v").alias("x")).groupBy("script", "lang", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("script", "lang", "measure")
    up = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(own))
    quarter = lambda m, q: (F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("total")), F.col("bin"))) + 0.5) * STEPS[m]
    at = ranked.groupBy("script", "lang").agg(F.max("total").alias("n"), *[quarter(m, q).alias(f"{m}_{k}") for m in STEPS for k, q in (("lo", 0.25), ("hi", 0.75))])
    out = []
    for m in STEPS:
        lo, hi = F.col(f"{m}_lo"), F.col(f"{m}_hi")
        spread = F.greatest(hi - lo, F.lit(LEAST_BYTES) if m == "byte_share" else LEAST_SPREAD * (lo + hi) / 2)
        out += [(lo - LOW * spread).alias(f"{m}_lo"), (hi + HIGH * spread).alias(f"{m}_hi")]
    raw = checkpointed(at.select("script", "lang", "n", *out))
    scripts = checkpointed(_towards(raw.where("lang IS NULL"), fixed_bands(found.sparkSession)))
    return scripts.unionByName(_towards(raw.where("lang IS NOT NULL"), scripts))


def judged(found: DataFrame) -> DataFrame:
    """The rows of measured() with kept."""
    fitted = checkpointed(fitted_bands(found))
    small = fitted.count() <= BROADCAST_ROWS
    sides = []
    for prefix, part in (("by_lang", fitted.where("lang IS NOT NULL")), ("by_script", fitted.where("lang IS NULL"))):
        side = part.select("script", *(["lang"] if prefix == "by_lang" else []), F.struct(*[f"{m}_{k}" for m in STEPS for k in ("lo", "hi")]).alias(prefix))
        sides.append(F.broadcast(side) if small else side)
    met = found.join(sides[0], ["script", "lang"], "left").join(F.broadcast(sides[1]), "script", "left")  # scripts are few
    ok = F.lit(False)
    for script, b in BANDS.items():
        inside = F.col("chars_per_token").between(
            b.min_chars_per_token,
            b.max_chars_per_token,
        ) & (F.col("byte_share") <= b.max_byte_share) & F.col("token_entropy").between(b.min_entropy, b.max_entropy)
        ok = F.when(F.col("script") == script, inside).otherwise(ok)
    fit = F.coalesce("by_lang", "by_script")
    for m in STEPS:
        ok = ok & F.coalesce(F.col(m).between(fit[f"{m}_lo"], fit[f"{m}_hi"]), F.lit(True))
    return met.withColumn("kept", ~F.col("base_failed") & ok).drop("by_lang", "by_script")


def measure(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts, fertility measures and verdict of every document."""
    found = judged(measured(docs, docs["doc_id"].cast("long").alias("doc_id"), vocabulary))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "script",
        "chars_per_token",
        "byte_share",
        "token_entropy",
    )


def keep(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows whose texts pass the rules, with all their columns; no row is shuffled."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    kept = judged(measured(docs, row, vocabulary)).where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    return measure(table(spark, sf_dir, "documents"))
