"""Byte-level BPE, token alignment and conversation repair against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from kinegrid.llm import byte_bpe as bb
from kinegrid.llm import token_align as ta
from kinegrid.llm import turn_repair as tr

ALPHABET = ["a", "b", "the", "ing", "Ab", "'", "'l", "'ll", "'s", " ", "  ", "\n", "\t", "　", "é", "漢字", "1", "23", "!?", "#", "\U0001f600", "՘", "\x1c", "\xa0", "\x00", "<|endoftext|>", "<s>"]
ODD = ["", None, " ", " \n\t", "word", "a  b ", "é ü\nß", "x" * 5000, "<s> <0x0A> <|endoftext|> 日本語 \U0001f600", "\r\n\r\n", "'ll 's", " lead"]


def texts(seed: int, n: int, length: int = 80) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(length))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe() -> bb.ByteBpe:
    with open(bb.RANKS, "rb") as f:
        return bb.ByteBpe(f.read())


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    with open(bb.RANKS, "rb") as f:
        ranks = {bb.base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bb.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stitched(bpe: bb.ByteBpe, text: str, chunk: int, overlap: int) -> list[int]:
    state = bb.Stitch(bpe)
    for start, last, part in bb.cut_text(text, chunk, overlap):
        state.add(start, last, part, *bb.split_chunk(bpe, part, last))
    return state.done().tolist()


def test_ids_are_those_of_the_library_in_chunks_of_any_size(bpe, library):
    for text in [*texts(1, 400), *(t or "" for t in ODD)]:
        want = library.encode_ordinary(text)
        assert bpe.encode(text).tolist() == want
        assert bpe.decode(bpe.encode(text)) == text.encode()
        for chunk, overlap in ((5, 3), (7, 5), (16, 8), (30, 4)):
            assert stitched(bpe, text, chunk, overlap) == want, (text, chunk, overlap)


def test_pre_tokens_longer_than_an_overlap_are_stitched(bpe, library):
    text = "a" * 3000 + " b " + " " * 2000 + "x" + "\n" * 1500 + "y" + "!" * 999 + "\n \n" * 200 + "end"
    for chunk, overlap in ((100, 20), (64, 2), (1000, 10)):
        assert stitched(bpe, text, chunk, overlap) == library.encode_ordinary(text)


def test_classes_of_characters_are_the_encoder_s(bpe, library):
    rng = random.Random(4)
    for odd in rng.sample(sorted(bpe.odd), 200) + ["՘", "࢏"]:
        text = f"a{odd}b 1{odd}2 !{odd}? {odd}"
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_byte_bpe_frames(spark, library):
    long = " ".join(texts(2, 60))
    rows = [(k, t, "kept", k) for k, t in enumerate([*ODD, long, long, "z" * 9000])] + [(None, long, None, 1), (0, "again", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int").withColumnRenamed("n_tokens", "token_ids").withColumn("row", bb.F.lit(1))
    encoded = bb.encode_texts(docs, chunk=1000, overlap=50)
    assert encoded.columns == ["doc_id", "text", "digest", "row", "token_ids", "n_tokens"]
    back = bb.decode_ids(encoded).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.token_ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert Counter(r.digest for r in back) == Counter(r[2] for r in rows)
    assert bb.encode_texts(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(None,), ([],)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in bb.decode_ids(nothing).collect()] == [b"", b""]


def test_op11(spark, sf_dir, library):
    got = {r.doc_id: r for r in bb.op11_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


@pytest.fixture(scope="module")
def aligner() -> ta.Aligner:
    with open(ta.TOKENIZER_A, encoding="utf-8") as a, open(ta.MODEL_B, "rb") as b:
        return ta.Aligner(a.read(), b.read())


class Plain:
    """The alignment of one text by the libraries, token by token."""

    def __init__(self) -> None:
        self.a = Tokenizer.from_file(ta.TOKENIZER_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=ta.MODEL_B)
        byte_of = {c: b for c, b in ta.byte_alphabet().items()}
        self.raw_a = {k: bytes(byte_of[c] for c in t) for t, k in self.a.get_vocab(False).items()}

    def raw_b(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def __call__(self, text: str | None) -> tuple[int, int, int, int, str, Counter]:
        nothing = (0, 0, 0, 0, "", Counter())
        if not text:
            return nothing
        a, b, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        raw_a, raw_b = [self.raw_a[k] for k in a], [self.raw_b(k) for k in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            return nothing
        ends_a, ends_b = (list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b))
        groups, pairs, i, j = [], Counter(), 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            pairs.update(itertools.product(a[i:x], b[j:y]))
            i, j = x, y
        return len(a), len(b), len(groups), sum(pairs.values()), ";".join(groups), pairs


@pytest.fixture(scope="module")
def plain() -> Plain:
    return Plain()


def aligned_as(found: ta.Aligned, k: int) -> tuple:
    low, high = found.bounds[k], found.bounds[k + 1]
    links = zip(found.a[low:high].tolist(), found.b[low:high].tolist(), found.times[low:high].tolist(), strict=True)
    return (*found.counts[k].tolist(), found.groups[k], Counter({(a, b): n for a, b, n in links}))


def test_alignment_equals_that_of_single_tokens(aligner, plain):
    some = [*texts(3, 500, 40), "", "a▁b", "漢字" * 100, "zqxjk" * 50, "\U0001f600" * 60, "x\n y", "tail ", " ", "   ", "\n", "▁"]
    for _ in range(2):  # fresh, and remembered
        found = aligner.align(some)
        for k, text in enumerate(some):
            assert aligned_as(found, k) == plain(text), text
    assert len(aligner.align([]).groups) == 0


def test_alignment_without_stretches_or_fast_encoder(plain):
    with open(ta.TOKENIZER_A, encoding="utf-8") as a, open(ta.MODEL_B, "rb") as b:
        whole = ta.Aligner(a.read(), b.read())
    whole.split = False
    whole.encode_a = lambda many: [e.ids for e in whole.a.encode_batch_fast(many, add_special_tokens=False)]
    some = texts(5, 200, 40)
    found = whole.align(some)
    assert all(aligned_as(found, k) == plain(t) for k, t in enumerate(some))


def test_a_group_of_many_tokens_is_reduced_to_its_ids(aligner, monkeypatch):
    some = ["漢字" * 100, "word and 日本語日本語", "é" * 90]
    want = [aligned_as(aligner.align(some), k) for k in range(3)]
    monkeypatch.setattr(ta, "WIDE", 1)
    assert [aligned_as(aligner.align(some), k) for k in range(3)] == want


def brute_totals(found: list[tuple]) -> list[tuple[int, int]]:
    counts = Counter(p for f in found for p in f[5])
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(sum(n for p, n in f[5].items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in f[5].items())) for f in found]


@pytest.mark.parametrize(("frequent", "held"), [(1 << 20, 500_000), (20, 3), (0, 1)])
def test_link_totals(spark, plain, frequent, held, monkeypatch):
    some = [*texts(6, 120, 60), *ODD, "again and again", "again and again"]
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(some)], "row long, text string, n_a int, _text string")
    aligned = ta.align_texts(docs)
    assert aligned.columns == ["row", "_text", *ta.COUNTS, "groups", "pair_a", "pair_b", "pair_n"]
    stored = aligned.checkpoint()
    found = [plain(t) for t in some]
    for r in stored.collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == found[r.row][:5]
    monkeypatch.setattr(ta, "HELD_PAIRS", held)
    got = {r.row: (r.n_best, r.count_sum) for r in ta.link_totals(stored, ta.pair_counts(stored), "row", frequent).collect()}
    assert [got[k] for k in range(len(some))] == brute_totals(found)


def test_op12(spark, sf_dir, plain):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = [plain(r.text) for r in rows]
    totals = brute_totals(found)
    got = {r.doc_id: r for r in ta.op12_token_align(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, f, (best, total) in zip(rows, found, totals, strict=True):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum) == (*f[:4], best, total)
        assert g.groups_sha256 == (hashlib.sha256(f[4].encode()).hexdigest() if f[0] else "")


def test_op12_of_rows_without_ids_and_of_none(spark, tmp_path, plain):
    rows = [(None, "one two"), (None, None), (3, "one two"), (3, "a▁b"), (3, "\n" + "x" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/some/documents.parquet")
    got = ta.op12_token_align(spark, f"{tmp_path}/some").collect()
    found = [plain(t) for _, t in rows]
    want = [(i, *f[:4], *t) for (i, _), f, t in zip(rows, found, brute_totals(found), strict=True)]
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got) == Counter(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ta.op12_token_align(spark, f"{tmp_path}/none").collect() == []


TURNS = "conv_id long, turn long, role string, text string"


def faults_of(rows: list[tuple]) -> list[str | None]:
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(tr.SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """By trying all edits; no more than two turns are inserted in a row, and none beyond the price of deleting all."""
    faults, begun = faults_of(rows), re.compile(r"(s?(ua)*u?)?")
    best, limit, stack = [], 3 * len(rows), [(0, "", 0, "", [])]
    while stack:
        at, roles, cost, audit, out = stack.pop()
        if cost > limit or not begun.fullmatch(roles):
            continue
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best.append((cost, audit, out))
            limit = cost
        if not audit.endswith("II"):
            stack += [(at, roles + new[0], cost + 2, audit + "I", [*out, f"{new}:"]) for new in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            stack.append((at + 1, roles, cost + 3, audit + "D", out))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                stack += [(at + 1, roles + new[0], cost + price + more, audit + letter, [*out, f"{new}:{text}"]) for new, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)) if new]
    return min(best, key=lambda w: w[:2])


def brute_repair(rows: list[tuple]) -> tuple:
    """(faults, illegal, cost, audit, digest) of (role, text) in order."""
    faults = faults_of(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, out = cheapest(rows)
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed: int, n: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", f"Number {turn}?", "Yes."])
            out.append((conv, rng.choice([turn, turn, turn, None, 2]), role, text))
    return out


def test_repairs_are_the_cheapest_and_least(spark):
    rows = conversations(7, 150)
    got = {r.conv_id: r for r in tr._summed_up(tr.repair_conversations(spark.createDataFrame(rows, TURNS).repartition(3))).collect()}
    by_conv: dict[int, list] = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        r = got[conv]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute_repair([x[2:] for x in sorted(own)]), sorted(own)
        turns = {t for known, t, *_ in own if known}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go on."), (1, 1, "user", "Go on."), (None, None, None, None), (2, None, "user", "A?"), (2, 5, "assistant", "B")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS + ", edit string, place int")
    got = [tuple(r) for r in tr.repair_conversations(docs).collect()]
    assert [r[1:] for r in got if r[0] == 1] == [
        (1, "I", None, None, "user", "", None),
        (2, "K", 0, "assistant", "assistant", "Hi.", None),
        (3, "K", 1, "user", "user", "Go on.", None),
        (4, "D", 1, "user", None, None, "duplicate"),
        (5, "I", None, None, "assistant", "", None),
    ]
    assert [r[1:] for r in got if r[0] is None] == [(1, "D", None, " ", None, None, "blank")]
    assert [(*r[2:6], r[7]) for r in got if r[0] == 2] == [("K", None, "user", "user", None), ("K", 5, "assistant", "assistant", "truncated")]
    assert tr.repair_conversations(docs.limit(0)).collect() == []


def test_a_long_conversation_crosses_batches(spark):
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["user", "assistant", "assistant"]), f"Turn {t}{rng.choice(['.', '', '?'])}") for t in range(3000)]
    rows += [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "Fine.")]
    r0, r1 = sorted(tr._summed_up(tr.repair_conversations(spark.createDataFrame(rows, TURNS))).collect())
    roles = "".join(r[2][0] for r in rows[:3000])
    # backwards over whole strings, which is exact as well
    step = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    costs = [0, 4, 2, 0]
    for t in range(2999, -1, -1):
        stays, new = not rows[t][3].endswith((".", "?")), []
        for q in range(4):
            options = [3 + costs[q], 2 + stays + costs[(2, 2, 3, 2)[q]]]
            if q in step[roles[t]]:
                options.append(stays + costs[step[roles[t]][q]])
            new.append(min(options))
        for _ in range(2):
            new = [min(c, 2 + new[(2, 2, 3, 2)[q]]) for q, c in enumerate(new)]
        costs = new
    assert r0.cost == costs[0] and len(r0.audit.replace("I", "")) == 3000
    assert (r1.cost, r1.audit) == (0, "KK")


def damaged_plainly(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_op13_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c if c else None, t, r and rng.choice([r, r, None]), x and rng.choice([x, x, None])) for c, t, r, x in conversations(12, 120)]
    rows += [(900 + k, 0, "user", "Alone.") for k in range(60)]
    spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", audit int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in tr.op13_turn_repair(spark, str(tmp_path)).collect()}
    want = damaged_plainly(rows)
    assert got.keys() == want.keys() and any(not own for own in want.values())
    for conv, own in want.items():
        turns = {t for known, t, *_ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert tuple(got[conv])[1:] == (gaps, *brute_repair([x[2:] for x in sorted(own)])), sorted(own)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    said = con.sql(tr.OP13_SQL)
    assert {r[said.columns.index("conv_id")]: tuple(r) for r in said.fetchall()} == {c: tuple(r[n] for n in said.columns) for c, r in got.items()}


def test_op13_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert tr.op13_turn_repair(spark, str(tmp_path)).collect() == []
    assert np.all(np.array(tr.AT_END) == [0, 4, 2, 0])
