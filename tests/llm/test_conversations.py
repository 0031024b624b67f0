"""The prefix trie, structure repair and packing by powers of two, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evtrail.llm import packing, repair, trie

ROWS = "conv_id long, turn long, role string, text string, depth int, gone_by string"


def conversations(seed: int = 5) -> list[tuple]:
    """Bases and copies with shared heads, gaps, null and repeated turns, one long conversation."""
    r = random.Random(seed)
    says = ["Yes.", "no", "", None, "What? ", "Why!", " \t", "é so.", "a longer one, of words."]
    rows = []
    for c in [*range(0, 12), *range(100, 109), 205, 207, *range(300, 330)]:
        if c in (104, 306):
            continue
        turns, like = r.choice([1, 2, 4, 9, 14]), random.Random(c % 3)
        for t in range(turns):
            q = like if r.random() < 0.7 else r
            rows.append((c, None if q.random() < 0.05 else t + (t > 3), q.choice(["user", "assistant", "user", "assistant", "system", None, "odd"]), q.choice(says)))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows += [(7, 100 + t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in conversations()], ROWS).repartition(3)


def turn_key(r):
    return (r[1] is not None, r[1] or 0)


def plain_trie(rows):
    own = defaultdict(list)
    for r in rows:
        role, text = r[2] or "", r[3] or ""
        own[r[0]].append((turn_key(r), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = hashlib.sha256(",".join(str(c) for c, last in m if last).encode()).hexdigest()
        out.append((m[0][0], len(k), members[k[:-1]][0][0] if k else None, len(m), children[k], sum(not children[x] for x in below), saved, ends))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_against_plain_python(talk, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "PIECE", 2)
    got = trie.prefix_trie(talk).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(conversations())


def test_trie_without_rows_and_without_ids(spark):
    assert trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    one = spark.createDataFrame([(None, 1, "user", "x"), (5, None, None, None)], "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(one).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie([(5, None, None, None)])


def test_trie_takes_other_bases_where_prints_agree_by_chance(talk, monkeypatch):
    tried = []

    def bases(seed):
        tried.append(seed)
        return [1, 1, 1] if seed == 0 else real(seed)  # the base 1 forgets the order

    real = trie._bases
    monkeypatch.setattr(trie, "_bases", bases)
    one, two = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 0][:2]  # nothing is cut off
    swapped = [(one, 1, "user", "a"), (one, 2, "user", "b"), (two, 1, "user", "b"), (two, 2, "user", "a")]
    got = trie.prefix_trie(talk.sparkSession.createDataFrame(swapped, "conv_id long, turn long, role string, text string")).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(swapped) and tried == [0, 1]


def cheapest(rows, costs, most=1):
    """All edits, with up to `most` insertions; rows are (role, text, must go, truncated)."""
    best, form = None, re.compile(r"(s?(ua)+)?\Z")

    def go(i, left, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if form.match("".join(r[0] for r, _ in out)):
                best = min(x for x in (best, (cost, audit, tuple(out))) if x is not None)
        else:
            role, text, must_go, truncated = rows[i]
            go(i + 1, left, cost + costs.delete, audit + "D", out)
            if not must_go:
                more = costs.truncated * truncated
                go(i + 1, left, cost + costs.keep + more, audit + "K", [*out, (role, text)])
                for name in ("user", "assistant"):
                    go(i + 1, left, cost + costs.rerole + more, audit + "R", [*out, (name, text)])
        if left:
            for name in ("user", "assistant"):
                go(i, left - 1, cost + costs.insert, audit + "I", [*out, (name, "")])

    go(0, most, 0, "", [])
    return best


def viterbi(rows, costs):
    out = []
    v = repair.Viterbi(lambda e, p: out.append((e, p)), costs)
    for row in rows:
        v.push(*row)
    cost = v.finish()
    return cost, "".join(e for e, _ in out), tuple(p for _, p in out if p)


def test_viterbi_against_all_edits():
    r = random.Random(2)
    roles = ["user", "user", "assistant", "system", "odd"]
    for n in range(400):
        costs = repair.Costs() if n % 3 else repair.Costs(r.choice([0, 1]), r.choice([1, 2]), r.choice([1, 2, 4]), r.choice([5, 6]), r.choice([0, 1, 5]))
        rows = [(r.choice(roles), str(i), r.random() < 0.15, r.random() < 0.25) for i in range(r.randint(0, 6))]
        assert viterbi(rows, costs) == cheapest(rows, costs)
    for _ in range(60):  # cheap insertions, also beside each other
        rows = [(r.choice(roles), str(i), False, False) for i in range(r.randint(1, 3))]
        assert viterbi(rows, repair.Costs(insert=1)) == cheapest(rows, repair.Costs(insert=1), 4)


def test_viterbi_gives_out_early_and_holds_ties():
    v, out = repair.Viterbi(lambda e, p: out.append(e)), []
    v.emit, most = lambda e, p: out.append(e), 0
    for i in range(5000):
        v.push(("user", "assistant")[i % 2], "x", i % 50 == 9, False)
        most = max(most, v.live)
    assert most < 100 and len(out) > 4900  # final edits leave
    v = repair.Viterbi(lambda e, p: out.append(e))
    out.clear()
    for _ in range(3001):
        v.push("user", "x", False, False)  # the last row decides which was dropped first
    v.finish()
    assert "".join(out) == "D" + "KR" * 1500


def plain_report(rows):
    """The repair report of conversations, row by row, with the Viterbi tested above."""
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        by[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[c] += [((turn is not None, turn or 0), "user" if kind == 4 else role, text, turn)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, found in by.items():
        found.sort(key=lambda x: x[:3])
        turns = {x[3] for x in found} - {None}
        seen, ready, count = set(), [], Counter()
        for _, role, text, _ in found:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            ready.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, kept = viterbi(ready, repair.Costs())
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(ready, ready[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_repair_against_plain_python(talk):
    got = repair.report(repair.damaged(talk)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    want = plain_report(conversations())
    assert sorted(map(tuple, got)) == want
    edits = defaultdict(list)
    for r in repair.repair(repair.damaged(talk)).collect():
        edits[r.conv_id].append(tuple(r)[1:])
    for c, *_, audit, digest in want:
        rows = sorted(edits[c])
        assert "".join(e for _, e, *_ in rows) == audit
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, e, role, text in rows if e != "D").encode()).hexdigest() == digest


def test_repair_of_odd_tables(spark):
    assert repair.report(repair.damaged(spark.createDataFrame([], ROWS))).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None), (3, 1, "user", "only.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.report(nothing).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[None].blank == 1 and got[None].audit == "D" and got[None].repaired_sha256 == empty
    assert (got[3].cost, got[3].audit) == (2, "D")
    with pytest.raises(ValueError):
        repair.Viterbi(print, repair.Costs(insert=0))


ODD = [" a  b\n\n c\t　d e 's'll don't １２ 12345 <|endoftext|> \x1c\x85 é́😀\x00", "  ", "a ", " a", "x" * 3000, "\r\n" * 50, "a 　 b", "a\t  b\n\n\n  c ", "a\x1c b"]


def tokens(texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_against_plain_python(spark, docs, texts):
    every = docs.select("doc_id", "text", "words").union(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, words string"))
    want = {**dict(enumerate(tokens(texts))), **{1000 + i: x for i, x in enumerate(tokens(ODD))}}
    got = packing.pack(every.repartition(3), path=packing.VOCABULARY).collect()
    per = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) and r.length & (r.length - 1) == 0 and r.length <= packing.SIZE and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
        assert ids == want[r.doc_id][r.start : r.start + r.length]
        per[r.doc_id].append((r.start, r.length))
    assert set(per) == set(want) and len({r.sequence_id for r in got}) == len(got)
    for i, pieces in per.items():
        at = 0
        for start, length in sorted(set(pieces)):
            assert start == at
            at += length
        assert at == len(want[i]) and len(pieces) == len(set(pieces)) * (2 if i == 8 else 1)  # row 8 is there twice
    order = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)  # equal lengths side by side
    small = packing.pack(every, size=4, end=7, ids=False).where("doc_id = 1000").collect()
    assert max(r.length for r in small) == 4 and "ids" not in small[0].asDict()


def test_packing_long_texts_and_small_caches(texts, monkeypatch):
    e = packing.Encoder(packing.VOCABULARY)
    monkeypatch.setattr(packing, "KEPT_IDS", 2000)
    whole = [t or "" for t in texts] + ODD
    want = [x[:-1] for x in tokens(whole)]
    for size in (1 << 22, 300):
        monkeypatch.setattr(packing, "BLOCK_BYTES", size)
        got = []
        for _, ids, ends in packing._ids_in_blocks(pa.array(whole), e):
            got += [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == want


def test_packing_buckets_and_empty_table(spark, empty, docs, tmp_path):
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, size=1000)
    packing.write_buckets(packing.pack(docs), str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where("bucket <> length").count() == 0 and back.count() == packing.pack(docs).count()
