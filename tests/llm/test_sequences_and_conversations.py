"""Packing, repair and prefix trie against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from genomeloom.llm import packing, prefix_trie, repair
from genomeloom.llm.textkernel import slices

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
ODD = ["a", "Word", "'s", "'ll", "'", "12", "3", " ", "  ", "\n", "\n\n", "\t", "\r", " ", "　", " ", " ", "é", "ß", "漢", "<|endoftext|>", "<|", ".", ",", "--", "…", "’", "\x85", "\x1c", "\x00", "😀", "don't", " 'tis", "_", "​", "ﬁ", "٣", "x1y2"]


def test_segments_give_the_tokenizers_ids(monkeypatch):
    plain, encode = tokenizers.Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(1)
    for turn in range(120):
        monkeypatch.setattr(packing, "KEPT", rng.choice([5, 60, 1 << 20]))
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(20)]
        if turn % 2:
            texts = [t.replace("<|endoftext|>", "") for t in texts]
        for lo, hi, data, rows in slices(pa.array(texts), 1 << rng.randrange(4, 12)):
            ids, size = encode(data, rows)
            ends = np.cumsum(size)
            for r in range(hi - lo):
                assert ids[ends[r] - size[r] : ends[r]].tolist() == plain.encode(texts[lo + r], add_special_tokens=False).ids, texts[lo + r]


def fewest(sizes, capacity):
    """Least number of sequences by trying all ways, for few pieces."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(room)
            put(k + 1, [*rooms[:at], room - sizes[k], *rooms[at + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_bin_completion_is_valid_and_near_the_optimum():
    rng = random.Random(2)
    met = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        counts = dict(Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))))
        plan = packing.complete(counts, capacity, 400)
        used = sum(n for _, n in plan)
        got = Counter()
        for pattern, many in plan:
            assert sum(s * n for s, n in pattern) <= capacity
            for s, n in pattern:
                got[s] += n * many
        assert got == counts
        least = fewest([s for s, n in counts.items() for _ in range(n)], capacity)
        assert packing.lower_bound(counts, capacity) <= least <= used <= sum(n for _, n in packing.best_fit(counts, capacity))
        met += used == least
    assert met >= 148
    large = {s: 50 + s % 7 for s in range(1, 200)}
    assert sum(n for _, n in packing.complete(large, 200)) <= sum(n for _, n in packing.best_fit(large, 200))
    assert packing.complete({}, 10) == []


def test_packing(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " ", "word " * 3000, "x" * 5000, "same", "same"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(k, t, 0, 1) for k, t in enumerate(texts)] + [(None, "no id", 0, 1), (5, "same", 0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, offset int, nth int").repartition(5)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    plain = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, at in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[at : first if piece == 0 else at + 1024]
            want[doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = packing.op11_packing(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate((n for _, n in parts[:-1]), initial=0)) and sum(n for _, n in parts) <= 1024
    packed = packing.pack(table, PATH)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == r["ids"]
    assert packing.pack(table.limit(0), PATH).count() == 0


def brute_edits(rows):
    """(cost, letters) by all ways, compared as pairs."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    ways = {0: (0, "")}

    def inserted(ways):
        for _ in range(3):
            for q, (cost, word) in list(ways.items()):
                ways[turn[q]] = min(ways.get(turn[q], (10**9, "")), (cost + 5, word + "I"))
        return ways

    for initial, fault in rows:
        new = {}
        for q, (cost, word) in inserted(ways).items():
            steps = [(q, 2, "D")]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.TRUNCATED else 0
                steps.append((turn[q], 1 + more, "R"))
                if initial in after[q]:
                    steps.append((after[q][initial], more, "K"))
            for to, more, letter in steps:
                new[to] = min(new.get(to, (10**9, "")), (cost + more, word + letter))
        ways = new
    ways = inserted(ways)
    return min(ways[q] for q in (0, 3) if q in ways)


def test_cheapest_edits():
    rng = random.Random(4)
    for _ in range(500):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        assert repair.cheapest_edits(rows) == brute_edits(rows), rows
    rows = [(rng.choice("sua"), rng.choice([0, 0, 3])) for _ in range(1500)]
    assert repair.cheapest_edits(rows) == brute_edits(rows)


def brute_repair(rows):
    """The contract's row of one conversation after damage; rows of (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, marked = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        marked.append((role[:1], 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, letters = brute_edits(marked)
    out, k, state = [], 0, 0
    for letter in letters:
        if letter == "I":
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            out.append({2: "user:", 3: "assistant:"}[state])
            continue
        _, role, text = rows[k]
        k += 1
        if letter == "D":
            continue
        state = {"s": 1, "u": 2, "a": 3}[role[0]] if letter == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
        out.append(f"{role if letter == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:]))
    n = Counter(f for _, f in marked)
    return gaps, n[1], n[2], n[3], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([None, t, t, t, t + 1]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["Fine.", "Fine.", "cut off", "a.b!", " \n", "", None, "é? ", "long " * 2000 + ".", f"t{t}!"]), 0.5, "x"))
    rows += rows[:7] + [(77, 1, "user", "x.", 0.5, "x")] * 3
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost double, audit string").repartition(4)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    damaged = defaultdict(list)
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        damaged[c] += [(t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] * {0: 0, 3: 2}.get(fate, 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op12_repair(spark, str(tmp_path)).collect()}
    assert got == {c: brute_repair(damaged[c]) for c in {r[0] for r in rows}}
    empty = table.limit(0)
    found, repaired = repair.repair(empty)
    assert found.count() == 0 and repaired.count() == 0


def brute_trie(rows):
    held = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            held[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    held = {c: [x for _, x in sorted(v)] for c, v in held.items()}
    built = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(held.get(c - c % 5, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    below = defaultdict(list)
    for key in nodes:
        for d in range(len(key) + 1):
            below[key[:d]].append(key)
    out = []
    for key, members in nodes.items():
        inner = below[key]
        children = [k for k in inner if len(k) == len(key) + 1]
        leaves = sum(not [x for x in below[k] if len(x) == len(k) + 1] for k in inner)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in inner if k)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == key)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_prefix_trie(spark, tmp_path):
    rng = random.Random(6)
    words = ["a", "b", "", None, "é" * 9]
    rows = []
    for c in [*range(-3, 70), 500, None]:
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.choice([0, 1, 2, 3, 4, 9, 12]))]
    long = [(t, "user", f"turn {t % 3}") for t in range(40)]
    for c, n in ((1001, 40), (1002, 40), (1003, 23), (1004, 31), (1006, 8)):  # conversations that end inside one another
        rows += [(c, *x) for x in long[:n]]
    rows += [(c, 0, "system", "hello") for c in range(2000, 2040)] + rows[:5]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string").repartition(4)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == prefix_trie.RESULT and sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(rows)
    assert prefix_trie.trie(prefix_trie.rebuilt(table.limit(0))).count() == 0
