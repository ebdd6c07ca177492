"""Conversation repair, resharding and resampling against plain versions, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from cases import benchmark, documents, texts

from lociworks.llm import repair, resampling, sharding
from lociworks.llm.common import ASCII_LOWER, written

# repair -----------------------------------------------------------------------------------------


def slow_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """The least (cost, audit) of all edit scripts whose roles match the form, by trying every target length."""
    best = None
    for k in range(2 * len(rows) + 4):
        if k == 1:
            continue
        target = ("s" if k % 2 else "") + "ua" * (k // 2)
        costs: dict[tuple[int, int], tuple[int, str]] = {(len(rows), len(target)): (0, "")}
        for i, j in itertools.product(range(len(rows), -1, -1), range(len(target), -1, -1)):
            options = [costs[i, j]] if (i, j) in costs else []
            if j < len(target) and target[j] != "s" and (i, j + 1) in costs:
                options.append((costs[i, j + 1][0] + 2, "I" + costs[i, j + 1][1]))
            if i < len(rows):
                initial, fault = rows[i]
                if (i + 1, j) in costs:
                    options.append((costs[i + 1, j][0] + 3, "D" + costs[i + 1, j][1]))
                if fault not in (1, 2) and j < len(target) and (i + 1, j + 1) in costs:
                    cost, audit = costs[i + 1, j + 1]
                    more = fault == 3
                    if initial == target[j]:
                        options.append((cost + more, "K" + audit))
                    if target[j] != "s":
                        options.append((cost + 2 + more, "R" + audit))
            if options:
                costs[i, j] = min(options)
        if (0, 0) in costs and (best is None or costs[0, 0] < best):
            best = costs[0, 0]
    return best


def test_cheapest_least_edits():
    rng = random.Random(4)
    for n in [0, 1, 2, 3, 4, 5, 7, 9, 12] * 12:
        rows = [(rng.choice("suaatx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        assert repair.tight_edits(rows) == slow_edits(rows), rows


def slow_conversations(rows: list[tuple]) -> set[tuple]:
    """rows (conv_id, turn, role, text) by the statement of the contract, one conversation after the other."""
    spaced = lambda v: " " if v is None else str(v)
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, spaced(role), hashlib.md5(spaced(text).encode()).hexdigest(), turn, spaced(text)))
    out = set()
    for conv, own in groups.items():
        kept = []
        for _, _, role, _, turn, text in sorted(own):
            fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
            if fate == 0:
                continue
            role, text = ("user" if fate == 4 else role), ("" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            kept += [(turn, role, text)] * (2 if fate == 3 else 1)
        seen, coded = set(), []
        for _, role, text in kept:
            bare = text.rstrip(repair.SPACE)
            coded.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit = slow_edits(coded)
        turns = [t for t, _, _ in kept if t is not None]
        said, i, length = [], 0, len(audit.replace("D", ""))
        for letter in audit:
            role = "user" if (len(said) + length) % 2 == 0 else "assistant"
            if letter == "I":
                said.append(f"{role}:")
                continue
            if letter != "D":
                said.append(f"{kept[i][1] if letter == 'K' else role}:{kept[i][2]}")
            i += 1
        pairs = [a[0] + b[0] for a, b in zip(coded, coded[1:], strict=False)]
        faults = Counter(f for _, f in coded)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, faults[1], faults[2], faults[3], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def awkward_conversations() -> list[tuple]:
    rng = random.Random(8)
    said = ["Yes.", "No!", "open end", "", " \n", None, "What? ", "ünïcode 😀", "same."]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, 5, "assistant", "So."), (100, 2**40, "assistant", "So.")]
    rows += [(None, 1, "user", "Who?"), (None, None, None, None), (7, 3, "user", "again."), (7, 3, "user", "again.")]
    return rows + [(200, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(70)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark, tmp_path):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA + ", audit string, place string, kind int").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_conversation_repair(spark, str(tmp_path))
    assert got.count() == len({r[0] for r in rows})
    assert {tuple(r) for r in got.collect()} == slow_conversations(rows)


def test_repaired_turns_read_as_pairs(spark):
    rows = repair.damage(spark.createDataFrame(awkward_conversations(), SCHEMA))
    found = written(repair.audits(rows))
    turns = repair.repaired_turns(rows, found).orderBy("conv_id", "at").collect()
    said: dict = {}
    for t in turns:
        assert t.at == len(said.setdefault(t.conv_id, []))
        said[t.conv_id].append(t.role[0])
    assert said and all(re.fullmatch("s?(ua)+", "".join(s)) for s in said.values())


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_conversation_repair(spark, str(tmp_path)).count() == 0

# resharding -------------------------------------------------------------------------------------


def test_flow_costs_least():
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        supply, prices = [rng.randrange(4) for _ in range(n)], [[rng.randrange(5) for _ in range(m)] for _ in range(n)]
        room = sharding.even_rooms(sum(supply), m)
        sent = sharding.flow(supply, room, lambda i, j, p=prices: p[i][j])
        assert [sum(r) for r in sent] == supply and all(sum(c) <= r for c, r in zip(zip(*sent, strict=True), room, strict=True))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        ways = [w for w in itertools.product(range(m), repeat=len(units)) if all(w.count(j) <= room[j] for j in range(m))]
        least = min(sum(prices[i][j] for i, j in zip(units, w, strict=True)) for w in ways)
        assert sum(prices[i][j] * sent[i][j] for i in range(n) for j in range(m)) == least
    supply = [rng.randrange(1000) for _ in range(12)]
    room = sharding.even_rooms(sum(supply), 12)
    sent = sharding.flow(supply, room, lambda i, j: int(i != j))
    assert sum(sent[i][j] for i in range(12) for j in range(12) if i != j) == sum(max(0, s - r) for s, r in zip(supply, room, strict=True))
    with pytest.raises(ValueError):
        sharding.flow([3], [2], lambda i, j: 0)


@pytest.mark.parametrize("files, blocks", [(1, 4096), (9, 4096), (9, 5)])
def test_shards_of_equal_bytes(spark, tmp_path, files, blocks):
    rng = random.Random(6)
    rows = [*texts(), *[(1000 + i, "w" * rng.randrange(400)) for i in range(3000)], *[(5, "copy")] * 1000]
    path = f"{tmp_path}/documents.parquet"
    documents(spark, rows).withColumnRenamed("w", "shard").withColumnRenamed("h", "slot").repartition(files).write.parquet(path)
    docs = spark.read.parquet(path)
    made = sharding.plan(docs, 4, blocks=blocks)
    assert sum(made.sizes()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    largest = max(p.size for p in made.pieces if p.block is not None)
    assert max(made.sizes()) - min(made.sizes()) <= largest and (blocks < 4096 or max(made.sizes()) - min(made.sizes()) < 50)
    layout = sharding.rewrite(docs, made, f"{tmp_path}/new")
    got = layout.rows().selectExpr("row.*", "shard AS new_shard", "slot AS new_slot").collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((i, t, None if t is None else len(t)) for i, t in rows)
    for j in range(4):
        assert sorted(r.new_slot for r in got if r.new_shard == j) == list(range(sum(r.new_shard == j for r in got)))
    again = {(r.doc_id, r.new_shard, r.new_slot) for r in sharding.rewrite(docs, sharding.plan(docs, 4, blocks=blocks), f"{tmp_path}/again").rows().selectExpr("row.*", "shard AS new_shard", "slot AS new_slot").collect()}
    assert again == {(r.doc_id, r.new_shard, r.new_slot) for r in got}
    manifest = layout.manifest().collect()
    assert sum(m.n_rows for m in manifest) == len(rows)
    assert not {m.path for m in manifest} & set(made.affected)


def test_only_what_moves_is_written(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    documents(spark, [(i, "x" * 99) for i in range(800)]).repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    home = {f.rpartition("/")[2]: i % 4 for i, f in enumerate(sorted(docs.inputFiles()))}
    of_file = lambda f, n: home[f.rpartition("/")[2]]
    made = sharding.plan(docs, 4, old=of_file)
    assert not made.affected and sharding.rewrite(docs, made).folder is None and sharding.rewrite(docs, made).rows().count() == 800
    made = sharding.plan(docs, 4, rooms=[30_000, 20_000, 20_000, 10_000], old=of_file)
    assert made.sizes() == [30_000, 20_000, 20_000, 10_000] and len(made.affected) == 1
    assert sum(p.size for p in made.pieces if p.old != p.shard) == 10_000


def test_sharding_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op11_sharding(spark, str(tmp_path)).count() == 0
    assert sharding.stored(documents(spark)).count() == len(texts())


# resampling -------------------------------------------------------------------------------------


def slow_weights(rows: list[tuple], goal: list[str | None], n: int, buckets: int) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t: str | None) -> list[int]:
        w = word.findall((t or "").translate(ASCII_LOWER))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in goal for b in features(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(word.findall((x or "").translate(ASCII_LOWER))), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("n, head, piece", [(1, 1 << 16, 1 << 20), (1, 5, 40), (2, 7, 50), (3, 4, 60)])
def test_weights_equal_brute_force(spark, monkeypatch, n, head, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    goal = [r.text for r in benchmark(spark).collect()]
    weighed = resampling.weigh(documents(spark), benchmark(spark), n, 500, head)
    want = slow_weights(texts(), goal, n, 500)
    assert Counter(map(tuple, weighed.collect())) == Counter(w[:4] for w in want)
    drawn = resampling.draw(weighed, percent=40).collect()
    assert Counter((r.doc_id, r.score) for r in drawn) == Counter((w[0], w[4]) for w in want)
    able = sorted(((w[4], w[0]) for w in want if w[1] >= 20), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
    ranked = sorted(((r.rank, r.score, r.doc_id) for r in drawn if r.rank), key=lambda r: r[0])
    k = 40 * len(able) // 100
    assert [r[0] for r in ranked] == list(range(1, k + 1)) and [r[1:] for r in ranked] == able[:k]


def test_pieces_keep_words_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(200)).encode()
    monkeypatch.setattr(resampling, "PIECE", 17)
    assert [w for p in resampling.pieces(text) for w in p] == text.split()
    assert list(resampling.pieces(None)) == [] and list(resampling.pieces(b"...")) == [[]]


def test_counters_cut_back():
    c = Counter({b"a": 9, b"b": 5, b"c": 5, b"d": 1})
    resampling.cut_back(c, 2)
    assert c == {b"a": 4}


def test_resampling_of_empty_tables(spark):
    none = documents(spark, [])
    assert resampling.draw(resampling.weigh(none, benchmark(spark))).count() == 0
    assert resampling.draw(resampling.weigh(documents(spark), none)).count() == len(texts())
