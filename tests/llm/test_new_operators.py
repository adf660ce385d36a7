"""Conversation repair against a shortest-path search, packing against the tokenizer library, divergence against a plain loop."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from prismtext.llm import conversations, divergence, packing
from prismtext.llm.common import documents

DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, kind int, gone string, seq int, code int, first int"
OWN = (1, "x", 2, 3, 4)


def repaired(rows):
    """What op11 returns for one conversation's damaged (turn, role, text): a search over (cost, initials)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        names = [n for n in ("user", "assistant") if n[0] in after]
        steps = [(3, "I", i, n[0], (f"{n}:",)) for n in names]
        if i < len(rows):
            steps.append((4, "D", i + 1, state, ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                steps += [(3 + more, "R", i + 1, n[0], (f"{n}:{rows[i][2]}",)) for n in names]
                if initials[i] and initials[i] in after:
                    steps.append((more, "K", i + 1, initials[i], (f"{rows[i][1]}:{rows[i][2]}",)))
        for c, edit, to, s, line in steps:
            heapq.heappush(heap, (cost + c, audit + edit, to, s, lines + line))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_op11(rows):
    by = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: repaired(found) for conv, found in by.items()}


def hard_turns():
    rnd = random.Random(3)
    rows = []
    for conv in (None, 1, 2, 3, 4, 5):
        for _ in range(rnd.choice([5, 40])):
            turn = None if rnd.random() < 0.1 else rnd.randrange(30)
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", None, "tool", "", "usr"]), rnd.choice(["a.", "b", "", None, "x!", "yes? \n", " ", "é"])))
    rows += rows[:5]
    gone = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows += [(7, gone, "user", "all rows of 7 are dropped."), (8, 1, "user", "long. " * 9000)]
    rows += [(9, t, rnd.choice(["user", "assistant", "system"]), f"t{t % 97}" + rnd.choice([".", ""])) for t in range(700)]
    return [(*r, *OWN) for r in rows]


@pytest.mark.parametrize("bits", [12, 4])
def test_conversations_equal_a_search(spark, monkeypatch, bits):
    """Also where the long conversation is dealt to many runs (of 16 turns) and tasks."""
    monkeypatch.setattr(conversations, "RUN_BITS", bits)
    rows = hard_turns()
    out = conversations.op11_conversations(spark.createDataFrame(rows, TURNS).repartition(5))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == plain_op11(rows)
    assert conversations.op11_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_conversations_of_the_table(spark):
    table = spark.read.parquet(f"{DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in conversations.op11_conversations(table).collect()} == plain_op11(rows)


def test_repaired_turns_alternate(spark):
    rows = [r for r in hard_turns() if r[0] != 9]
    left = conversations.repair(spark.createDataFrame(rows, TURNS)).where("edit <> 'D'").orderBy("conv_id", "seq", "k").collect()
    by = defaultdict(str)
    for r in left:
        by[r["conv_id"]] += r["role"][0]
    assert all(re.fullmatch("s?(ua)+", roles) for roles in by.values())


DOCS = "doc_id long, text string, lang string, source string, ids string, part int, window int, offset int, term string"


def hard_docs():
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice(["one", "Two", "three-four", "fünf", "sechs", "sieben"]) for _ in range(n))
    rows = [(i, prose(rnd.choice([0, 1, 50, 400])), ["en", "de", None][i % 3], ["a", "b", None, ""][i % 4]) for i in range(150)]
    rows += [(None, "no id", "en", "a"), (200, None, None, None), (201, prose(12_000), "de", "c"), (202, "x" * 50_000, "en", "a"), (203, "alone", "fr", "d"), (204, "", "fr", "e"), rows[1], rows[1]]
    return [(*r, "i", 1, 2, 3, "t") for r in rows]


def check_packing(rows, docs, size=4096):
    """Every id in one piece, sequences gapless, no padding at all. ``docs`` are (doc_id, text)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = Counter((i, t or "") for i, t in docs)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size and not at & (at - 1)
    assert sorted(sequences) == list(range(len(sequences)))
    want, got = Counter(), Counter((r["doc_id"], r["start"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    crc = defaultdict(Counter)
    for r in rows:
        crc[r["doc_id"], r["start"], r["length"]][r["ids_crc32"]] += 1
    own = {}
    for (i, t), n in texts.items():
        own.setdefault(i, []).append(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4"))
        want[i, 0, len(own[i][-1])] += n
    assert got == want
    assert sum(r["length"] for r in rows) == sum(k[2] * n for k, n in want.items())
    for (i, start, length), found in crc.items():
        possible = {zlib.crc32(ids[start : start + length].tobytes()) for ids in own[i]}
        assert set(found) <= possible


def test_packing_equals_the_library(spark):
    rows = hard_docs()
    out = packing.op12_packing(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    check_packing(out, [r[:2] for r in rows])
    table = documents(spark, DIR)
    check_packing(packing.op12_packing(table).collect(), [(r["doc_id"], r["text"]) for r in table.collect()])
    assert packing.op12_packing(spark.createDataFrame([], DOCS)).count() == 0


def test_windows_are_bounded_and_go_out_full():
    rnd, packer = random.Random(2), packing.Packer(64, 4)
    sizes = [rnd.randint(1, 150) for _ in range(500)]
    for i, n in enumerate(sizes):
        packer.add((i, n), np.full(n, i, "<u4"))
        assert len(packer.open) == 4
    rest = packer.close()
    assert all(sum(len(x[2]) for x in window) == 64 for window in packer.full)
    left = sum(len(x[2]) for x in rest)
    assert left < 64 and 64 * len(packer.full) + left == sum(sizes)


def plain_divergence(docs, least, top=50):
    docs = [tuple(x or "" for x in r) for r in docs]
    lower = {i: i + 32 for i in range(65, 91)}
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)), lang, source) for text, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(t for ts, own, _ in terms if own == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for _, own, s in docs if own == lang}
        for ts, own, s in terms:
            if own == lang:
                counts[s].update(t for t in ts if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("room", [4 << 20, 40])
def test_divergence_equals_a_plain_loop(spark, monkeypatch, room):
    """Also where a language's terms are dealt to several automata."""
    monkeypatch.setattr(divergence, "ROOM", room)
    rows = [r for r in hard_docs() if room > 40 or len(r[1] or "") < 50_000]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    for least in (1, 30) if room > 40 else (30,):
        got = divergence.divergence(frame, least).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(tuple(r) for r in got) == plain_divergence([r[1:4] for r in rows], least)
    assert divergence.op13_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (3, 10, 2), (10**13, 10**13, 10**9), (10**14 + 7, 8 * 10**15, 10**9)]
    rows = spark.createDataFrame(cases, "n long, total long, terms long").select("n", "total", "terms", divergence.share("n", "total", "terms").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 5) // (r["total"] + 5 * r["terms"]) for r in rows)
