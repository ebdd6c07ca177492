"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import benchmark, documents, texts
from pyspark.sql import functions as F

from lociworks.llm import bpe, chat, decontamination, licenses, lm, quality_model, quality_rules, secrets, simhash, toxicity
from lociworks.llm.common import ASCII_LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_bpe_equals_the_library(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids for _, t in texts()}
    want = Counter((i, hashlib.sha256(np.array(ids[t], dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids[t], skip_special_tokens=False).encode()).hexdigest()) for i, t in texts())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()) == want
    encoded = bpe.encode(docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(ids[t])) for i, t in texts())
    assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded).collect()) == Counter((i, t or "") for i, t in texts())
    assert bpe.digests(none).count() == 0


def test_long_pretokens_merge_like_short_ones(monkeypatch):
    import public_tokenizers

    model = bpe.RankArrayBpe(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 127, 128):
        word = bytes(rng.choice(list(b"theing"), n).tolist())
        monkeypatch.setattr(bpe, "SHORT", 1 << 20)
        short = model.merge(word)
        monkeypatch.setattr(bpe, "SHORT", 0)
        assert model.merge(word) == short


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be [SYS] kind </s>", "x"),
        (1, 1, "user", "[\\INST] <\\\\s> [ROLE]\n", "x"),
        (1, 2, "assistant", "[", "x"),
        (2, 0, "assistant", "out of turn", "x"),
        (3, 0, "weird [/ROLE]", "hi [/TURN]", "x"),
        (3, None, None, None, "x"),
        (None, 0, "user", "", "x"),
        (4, 0, "user", "tie b", "x"),
        (4, 0, "user", "tie a", "x"),
        (5, 0, "user", "q\n" * 40_000, "x"),
        (5, 1, "assistant", "<s>" * 9000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    chats = chat.format_chat(df)
    got = {r.conv_id: r for r in chats.select("conv_id", "valid", chat.parse_turns(chat.formatted_text(F.col("segments"))).alias("turns")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    assert [c for c in got if got[c].valid] and {c for c in got if got[c].valid} == {1, 5}
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert digest[1].loss_chars == 1 and digest[2].loss_sha256 == hashlib.sha256(b"out of turn").hexdigest()
    assert chat.digests(chat.format_chat(df.where("false"))).count() == 0


def test_template_refuses_ambiguous_marks():
    with pytest.raises(ValueError):
        chat.ChatTemplate(roles={"user": chat.Marks("<<u>>", "</u>")})


def windows_of(text: str | None) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, docs, none, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    bench = benchmark(spark)
    items = {(str(i) if i is not None else "null", w) for i, t in [(r.item_id, r.text) for r in bench.collect()] for w in windows_of(t)}
    want = Counter()
    for i, t in texts():
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for item, win in items:
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= {*range(at, at + len(win))}
                    found.add(item)
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    per = decontamination.phrase_matches(docs, bench).select("doc_id", "n_words", decontamination.covered(F.col("found")).alias("n"), "items")
    assert Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in per.collect()) == want
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, _, hits, _), n in want.items() if not hits)
    assert decontamination.phrase_matches(none, bench).count() == 0
    assert decontamination.phrase_matches(docs, bench.where("false")).where("size(found) > 0 OR n_near > 0").count() == 0


def near(words: list[str], window: tuple[str, ...], rarest: int, slop: int) -> dict[int, int]:
    """By brute force: where the window would start, as its rarest term has it, and how far its terms stand from there."""
    out = {}
    for p in [k for k, w in enumerate(words) if w == window[rarest]]:
        start = p - rarest
        gaps = [min((abs(k - at - start) for k, w in enumerate(words) if w == term), default=99) for at, term in enumerate(window)]
        if max(gaps) <= slop:
            out[start] = max(gaps)
    return out


def test_lists_meet_exactly_and_near(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), 40))) for i in range(30)] + [(30, "the quick brown extra foxes jumped"), (31, "the quick brown foxes jumped")]
    asked = [(100 + k, tuple(w)) for k, w in enumerate([["a"], ["b", "c"], ["a", "b", "a"], ["d", "c", "e", "f"], ["quick", "brown", "foxes"], ["a", "zzz"]])]
    docs = documents(spark, rows)
    frame = spark.createDataFrame([(k, list(w)) for k, w in asked], "win long, terms array<string>")
    known = decontamination.vocabulary(frame)
    postings = decontamination.index(docs, known)
    ids = {r.row: r.doc_id for r in postings.where(F.col("tid") == decontamination.HEADER).collect()}
    got = {(ids[r.row], r.win, r.start): r.apart for r in decontamination.matches(frame, known, postings).collect()}
    seen = Counter(w for _, t in rows for w in t.split())
    want = {}
    for k, window in asked:
        if all(seen[w] for w in window):
            rarest = min(range(len(window)), key=lambda a: (seen[window[a]], a))
            for i, t in rows:
                want |= {(i, k, s): gap for s, gap in near(t.split(), window, rarest, decontamination.SLOP).items()}
    assert got == want
    assert got[31, 104, 1] == 0 and {gap for (i, k, _), gap in got.items() if (i, k) == (30, 104)} == {1}
    assert {gap for gap in got.values()} == {0, 1, 2, 3}


def test_quality_counts(spark, docs, none):
    got = {}
    for r in quality_rules.measure(docs).collect():
        got[r.doc_id] = r
    for i, t in texts():
        w = SPLIT.findall(t or "")
        lines = [x for x in (t or "").split("\n") if SPLIT.search(x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if wins[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.measure(none).count() == quality_rules.keep(none).count() == 0


def slow_verdicts(rows: list[tuple[str | None, str | None]]) -> list[bool]:
    """By brute force: words tokenised by the library one by one, quartiles by counting, bands by hand."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = []
    for lang, t in rows:
        w = SPLIT.findall(t or "")
        ids = [i for x in w for i in sp.encode(x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if wins[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        n = len(ids) or 1
        entropy = -sum(c / n * np.log2(c / n) for c in Counter(ids).values())
        measures = (sum(map(len, w)) / n, sum(map(sp.is_byte, ids)) / n, entropy)
        got.append((len(w) < 50 or 100 * len(hit) > 50 * len(w), quality_rules.script_of(t or ""), lang, (len(w), len(ids)), measures))
    steps, bands = list(quality_rules.STEPS.values()), {}
    for group in sorted({(s, x) for _, s, lang, _, _ in got for x in (lang, None)}, key=lambda g: (g[1] is not None, str(g))):
        fixed = quality_rules.BANDS[group[0]]
        wider = bands.get((group[0], None)) if group[1] else [(fixed.min_chars_per_token, fixed.max_chars_per_token), (0, fixed.max_byte_share), (fixed.min_entropy, fixed.max_entropy)]
        kinds = {(n, tuple(round(float(x), 9) for x in m)) for bad, s, lang, n, m in got if not bad and s == group[0] and group[1] in (None, lang)}
        if kinds:
            bands[group] = []
            for k, step in enumerate(steps):
                at = sorted(int(m[k] / step) for _, m in kinds)
                lo, hi = ((at[int(np.ceil(q * len(at))) - 1] + 0.5) * step for q in (0.25, 0.75))
                spread = max(hi - lo, quality_rules.LEAST_BYTES if k == 1 else quality_rules.LEAST_SPREAD * (lo + hi) / 2)
                ends = (lo - quality_rules.LOW * spread, hi + quality_rules.HIGH * spread)
                bands[group].append(tuple((len(kinds) * x + quality_rules.PRIOR * y) / (len(kinds) + quality_rules.PRIOR) for x, y in zip(ends, wider[k])))
    out = []
    for bad, script, lang, _, (c, b, e) in got:
        fixed = quality_rules.BANDS[script]
        ok = fixed.min_chars_per_token <= c <= fixed.max_chars_per_token and b <= fixed.max_byte_share and fixed.min_entropy <= e <= fixed.max_entropy
        fit = bands.get((script, lang)) or bands.get((script, None)) or [(-1e9, 1e9)] * 3
        out.append(not bad and ok and all(lo <= x <= hi for x, (lo, hi) in zip((c, b, e), fit)))
    return out


def test_verdicts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PRIOR", 5)
    rng = np.random.default_rng(6)
    lexicon = {"en": "the committee will review proposal next week publish decision members read before annual meeting harbour lantern".split(), "de": "der ausschuss wird den vorschlag prüfen und seine entscheidung vor jahrestagung veröffentlichen laterne".split()}
    ranges = {"han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3), "arabic": (0x600, 0x6FF), "emoji": (0x1F300, 0x1F600), "any": (0x250, 0xD7FF)}
    junk = [(lang, " ".join("".join(map(chr, rng.integers(*r, 6))) for _ in range(60))) for r in ranges.values() for lang in ("en", None)]
    prose = [(lang, " ".join(rng.choice(w, int(rng.integers(60, 120))))) for lang, w in lexicon.items() for _ in range(60)]
    rows = [*prose, *prose[:5], *junk, ("en", None), (None, ""), ("xx", prose[0][1]), (None, prose[1][1]), ("de", prose[2][1])]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    want = slow_verdicts(rows)
    got = {r.doc_id: r.kept for r in quality_rules.measure(df).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert not any(want[len(prose) + 5 : len(prose) + 5 + len(junk)]) and sum(want[: len(prose)]) >= 0.85 * len(prose)
    assert sorted(r.doc_id for r in quality_rules.keep(df).collect()) == [i for i, k in enumerate(want) if k]


def test_scripts():
    assert [quality_rules.script_of(t) for t in ("abc", "привет", "日本語", "한국어", "ñandú")] == ["latin", "cyrillic", "han", "hangul", "latin"]


def test_secrets(spark, docs, none):
    model = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.scan(docs, model).collect()}
    for i, t in texts():
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [tuple(s) for s in got[i].base_found] == sorted(want)
        assert set(map(tuple, got[i].base_found)) <= set(map(tuple, got[i].all_found))
    assert any(s["rank"] == 3 for s in got[51].all_found)
    clean = secrets.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] is None and text[4] == "one" and "ghp_" not in text[51] and "ABCDEFGH" not in text[50]
    assert secrets.scan(none, model).count() == 0
    assert len(secrets.train(none)) == len(model)


def parts(meetings: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Meetings (place, diagonal) parted until neither places nor diagonals pause."""
    for value, pause in ((0, licenses.GAP), (1, licenses.DRIFT)):
        own = sorted(meetings, key=lambda m: m[value])
        for k in range(1, len(own)):
            if own[k][value] - own[k - 1][value] > pause:
                return parts(own[:k]) + parts(own[k:])
    return [meetings]


def slow_spans(text: str | None, templates: list[tuple[str, str]]) -> set[tuple[str, int, int, float]]:
    """By the statement: all meetings of a template's grams, parted at pauses, each span verified word by word, the fullest of overlapping ones."""
    k, out = licenses.K, []
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    for label, t in templates:
        tw = WORD.findall(t.translate(ASCII_LOWER))
        grams = {}
        for j in range(len(tw) - k + 1):
            grams.setdefault(tuple(tw[j : j + k]), []).append(j)
        met = [(p, p - j) for p in range(len(w) - k + 1) for j in grams.get(tuple(w[p : p + k]), [])]
        for g in parts(met) if met else []:
            first, last = min(p for p, _ in g), max(p for p, _ in g) + k - 1
            same = sum(any(first <= j + d <= last and w[j + d] == x for d in {d for _, d in g}) for j, x in enumerate(tw))
            if same >= licenses.COVERAGE * len(tw) and same >= licenses.DENSITY * (last - first + 1):
                out.append((label, first, last, same / len(tw), same))
    return {s[:4] for s in out if not any((t[4], t[3]) > (s[4], s[3]) and t[1] <= s[2] and s[1] <= t[2] for t in out)}


def test_licenses(spark, docs, none):
    got = licenses.scan(docs).collect()
    want = Counter()
    for i, t in texts():
        own = WORD.findall((t or "").translate(ASCII_LOWER))
        places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(own)) if tuple(own[k : k + len(phrase)]) == phrase)
        want[i, len(own), tuple(places), frozenset(slow_spans(t, licenses.TEMPLATES))] += 1
    assert Counter((r.doc_id, r.n_words, tuple((p["at"], p["label"]) for p in r.places), frozenset((s["label"], s["first_word"], s["last_word"], s["coverage"]) for s in r.found_spans)) for r in got) == want
    found = {r.doc_id: {s["label"] for s in r.found_spans} for r in got if r.found_spans}
    assert found[60] == {"apache-2.0"} and "gpl-3.0" in found[62] and set(found) <= {60, 61, 62}
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, [("x", "too short")])


def test_edited_notices(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        for edits in (0, 1, 4, 12):
            own = list(w)
            for _ in range(min(edits, len(w) // 4)):
                at = int(rng.integers(len(own)))
                own[at : at + int(rng.integers(0, 3))] = ["foreign"] * int(rng.integers(0, 3))
            rows.append((100 * k + edits, f"some words first {' '.join(own)} and last"))
    got = {r.doc_id: {(s["label"], s["first_word"], s["last_word"], s["coverage"]) for s in r.found_spans} for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {i: slow_spans(t, licenses.TEMPLATES) for i, t in rows}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in {s[0] for s in got[100 * k]} and max(s[3] for s in got[100 * k]) == 1


def test_one_edit_anywhere_keeps_the_label(spark):
    """Each long notice with one or two foreign words put in, or a word left out, at every place: its label, and no other."""
    rows, wanted = [], {}
    for label, text in licenses.TEMPLATES:
        w = text.split()
        for at in range(len(w)) if len(w) >= 30 else []:
            for own in (w[:at] + ["foreign"] + w[at:], w[:at] + ["two", "foreign"] + w[at:], w[:at] + w[at + 1 :]):
                wanted[len(rows)] = label
                rows.append((len(rows), f"before it {' '.join(own)} and after"))
    got = {r.doc_id: {s["label"] for s in r.found_spans} for r in licenses.scan(documents(spark, rows)).collect()}
    assert {i: got[i] for i in wanted if got[i] != {wanted[i]}} == {}


@pytest.mark.parametrize("head", [500_000, 5])
def test_lm(spark, docs, none, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    out = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))
    model, counts = lm.train(docs, out)
    got = lm.score(docs, model, counts).collect()
    cut = lambda t: [*SPLIT.findall((t or "").translate(ASCII_LOWER)), None]
    seen = Counter(w for i, t in texts() if i is None or i % 5 != 2 for w in cut(t))
    n, v = sum(seen.values()), len(seen)
    assert (model.n, model.v) == (n, v)
    want = sorted((i or -1, len(cut(t)), sum(seen[w] > 0 for w in cut(t)), round(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in texts())
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    empty, nothing = lm.train(none, out)
    assert lm.score(none, empty, nothing).count() == 0
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in lm.score(docs, empty, nothing).collect())


def test_filter_reads_quantised_counts(spark):
    n = np.random.default_rng(2).integers(1, 5000, 3000)
    h = lm.mixed(np.arange(3000, dtype=np.uint64))
    grams = spark.createDataFrame(list(zip(h.view(np.int64).tolist(), n.tolist())), "h long, n long")
    f = lm.build_filter(grams, int(lm.levels(n).sum()))
    got = f.count(h)
    assert (got >= n / 2).all() and np.mean((got >= n / 2) & (got <= 2 * n)) > 0.97
    assert (f.count(lm.mixed(np.arange(10**6, 10**6 + 3000, dtype=np.uint64))) > 0).mean() < 0.05


def slow_fingerprint(text: str | None) -> int:
    w = SPLIT.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block, broadcast", [(1024, 10**6), (2, 0)])
def test_simhash(spark, docs, none, monkeypatch, block, broadcast):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    rows = texts()
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = Counter((i, fps[k], least.get(root(k))) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(least.values())
    assert kept.count() == len({*least.values()}) + sum(c is None for _, _, c in want)
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


def test_every_link_shares_a_key_and_passes_the_chains(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(400):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    df = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(a.view(np.int64), b.view(np.int64)))], "k int, a long, b long")
    shared = df.select("k", F.array_intersect(simhash.keys(F.col("a")), simhash.keys(F.col("b"))).alias("s")).collect()
    assert all(r.s for r in shared)
    for r in shared:
        assert any(len(simhash.links(a[r.k : r.k + 1], b[r.k : r.k + 1], list(simhash.KEY_SETS.values())[key >> 32])[0]) for key in r.s)


def labelled(spark, good: str, bad: str, name: str):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        w = [*rng.choice(["harbour", "lantern", "meadow", "copper", "violin", "garden", "thunder", "window"], 60)]
        if i % 2:
            w[5], w[20], w[40] = bad, bad, bad
        rows.append((i, " ".join(w).replace("window", good)))
    docs = documents(spark, [*rows, *[(None, None), (1000, "")]])
    labels = spark.createDataFrame([(i, int(i % 2 == (name == "toxic"))) for i in range(400)] + [(None, 1), (7, None)], f"doc_id long, {name} int")
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(spark, "window", "stupid", "toxic")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(400)]) > 0.97
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    odd = toxicity.Scorer(model).score(["harbour lantern stupiid meadow stuupid copper stupidd violin " * 3, "harbour lantern garden meadow copper violin thunder " * 3])
    assert odd[0] > odd[1]
    none = toxicity.train(docs, labels.where("false"))
    assert all(r.score < 1e-6 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_quality_model(spark):
    docs, labels = labelled(spark, "window", "JUNK!!", "quality")
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 2 == 0) for i in range(400)]) > 0.97
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    none = quality_model.train(docs, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, none).collect())
    assert quality_model.score(docs.where("false"), model).count() == 0
