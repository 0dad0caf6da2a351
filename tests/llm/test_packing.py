import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import packing

from .data import WORD

LENGTHS = (8, 16, 32)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_places_every_piece_without_overlap(sizes):
    runs, bins = packing.pack_lengths(dict(Counter(sizes)), LENGTHS)
    held, rank = {}, 0
    for first, n, bin_, copies, offset, size in runs:
        assert first == rank
        rank += n
        for k in range(n):
            held.setdefault(bin_ + k // copies, []).append((offset + k % copies * size, size))
    assert rank == len(sizes) and Counter(s for x in held.values() for _, s in x) == Counter(sizes)
    ids = [(first + i, permitted, contents) for first, count, permitted, contents in bins for i in range(count)]
    assert [b for b, _, _ in ids] == sorted(held)
    for b, permitted, contents in ids:
        end = 0
        for at, size in sorted(held[b]):
            assert at == end
            end += size
        assert end == contents <= permitted and permitted == min(c for c in LENGTHS if c >= end)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_runs_follow_best_fit_decreasing_for_one_length(sizes):
    """With one permitted length the plan is plain best-fit decreasing, up to the order of equal bins."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if sum(b) + s <= 32]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    _, got = packing.pack_lengths(dict(Counter(sizes)), (32,))
    assert Counter(sum(b) for b in bins) == Counter({c: sum(n for _, n, _, x in got if x == c) for c in {x for _, _, _, x in got}})


def textbook(sizes, lengths, cost):
    """Best-fit decreasing over several lengths, item by item: (length, contents) of the bins."""
    sizes, bins = sorted(sizes, reverse=True), []
    for at, s in enumerate(sizes):
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += s
            continue
        left, smaller = sizes[at:].count(s), [x for x in sizes if x < s]

        def per_token(c):
            own = min(c // s, left)
            slack = c - own * s
            filler = sum(x for x in smaller if x <= slack)
            return cost(c, max(lengths)) / (own * s + min(slack, filler / -(-left // own))), c

        bins.append([min((c for c in lengths if c >= s), key=per_token), s])
    return Counter((min(c for c in lengths if c >= held), held) for _, held in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_runs_follow_best_fit_decreasing_for_several_lengths(sizes):
    """Item by item, with the bin sizes opened for one run of equal pieces at a time."""
    _, bins = packing.pack_lengths(dict(Counter(sizes)), LENGTHS)
    got = Counter()
    for _, n, length, held in bins:
        got[length, held] += n
    want = textbook(sizes, LENGTHS, packing.default_cost)
    spent = lambda found: sum(n * packing.default_cost(c, 32) for (c, _), n in found.items())
    assert sum(n * held for (_, held), n in got.items()) == sum(sizes) and spent(got) <= 1.1 * spent(want) + packing.default_cost(32, 32)


def test_the_tree_finds_the_tightest():
    tree, held = packing.RoomTree(100), set()
    for room in (3, 97, 40, 41, 100, 0, 64):
        tree.set(room, True)
        held.add(room)
        assert [tree.tightest(x) for x in range(101)] == [min((r for r in held if r >= x), default=None) for x in range(101)]
    for room in (41, 100):
        tree.set(room, False)
        held.discard(room)
        assert [tree.tightest(x) for x in range(101)] == [min((r for r in held if r >= x), default=None) for x in range(101)]


def test_several_lengths_cost_less_than_the_longest_alone():
    sizes = {s: 40 for s in range(1, 33)}
    cost = lambda found: sum(n * packing.default_cost(c, 32) for _, n, c, _ in found)
    assert cost(packing.pack_lengths(sizes, LENGTHS)[1]) <= cost(packing.pack_lengths(sizes, (32,))[1])
    fill = sum(s * n for s, n in sizes.items()) / sum(n * c for _, n, c, _ in packing.pack_lengths(sizes, LENGTHS)[1])
    assert fill > 0.97


def test_documents_are_cut_and_packed_whole(spark):
    rows = [(i % 50, 1 + (i * 37) % 90, "x") for i in range(400)] + [(None, 5, None), (7, 1000, "long")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, piece string"), lengths=LENGTHS).toPandas()
    assert list(out.columns) == ["doc_id", "n_tokens", "piece", "_piece", "piece_start", "piece_tokens", "bin_id", "bin_length", "bin_offset"]
    assert out["piece_tokens"].sum() == sum(n for _, n, _ in rows) and out["piece_tokens"].max() == 32
    assert sorted(out[out.n_tokens == 1000]["piece_start"]) == list(range(0, 1000, 32))
    for _, g in out.sort_values("bin_offset").groupby("bin_id"):
        ends = (g["bin_offset"] + g["piece_tokens"]).tolist()
        assert g["bin_offset"].tolist() == [0, *ends[:-1]] and g["bin_length"].nunique() == 1
        assert g["bin_length"].iloc[0] == min(c for c in LENGTHS if c >= ends[-1])


def test_sequences_hold_whole_texts_block_by_block(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bé", "\nc"]) for _ in range(rng.choice([0, 1, 7, 31, 32, 33, 64, 200]))) + rng.choice(["", " \t"]) for _ in range(300)] + [None, "   "]
    df = spark.createDataFrame([(None if i == 5 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bin_id int").coalesce(1)
    rows = packing.sequences(df, lengths=LENGTHS, block_tokens=400).collect()
    parts = defaultdict(dict)
    for r in rows:
        end = 0
        for id_, piece, text in zip(r.doc_ids, r.pieces, r.texts):
            assert piece.bin_offset == end
            end += piece.n_tokens
            assert piece.n_tokens == len(WORD.findall(text)) + piece.ends
            parts[id_][piece.piece] = (text, piece.ends)
        assert end == r.n_tokens <= r.bin_length == min(c for c in LENGTHS if c >= end)
    assert len({r.bin_id for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        mine = parts[None if i == 5 else i]
        assert "".join(mine[k][0] for k in range(len(mine))) == (t or "") and [mine[k][1] for k in range(len(mine))] == [False] * (len(mine) - 1) + [True]
    order = [min(-1 if i is None else i for i in r.doc_ids) for r in rows]
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) < 60 * len(order)  # neighbours in the table stay near
    assert packing.sequences(df.limit(0), lengths=LENGTHS).count() == 0


def test_names_that_clash(spark):
    out = packing.pack(spark.createDataFrame([(1, 5, 7, 8)], "doc_id long, n_tokens long, _pid int, bin_id int"), lengths=LENGTHS)
    assert out.columns == ["doc_id", "n_tokens", "_pid", "bin_id", "piece", "piece_start", "piece_tokens", "_bin_id", "bin_length", "bin_offset"] and out.count() == 1


def test_nulls_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = packing.query(spark, str(tmp_path)).toPandas()
    assert sorted(out["piece_tokens"]) == [1, 1, 1, 3] and out["bin_id"].nunique() == 1 and set(out["bin_length"]) == {512}
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


@pytest.mark.parametrize("histogram", [{}, {32: 1}, {1: 100_000_000}])
def test_plans_stay_small(histogram):
    runs, bins = packing.pack_lengths(histogram, LENGTHS)
    assert len(runs) <= 4 and len(bins) <= 4
