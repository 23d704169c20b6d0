"""Corpus operators against brute force, round trips and libraries: nulls, ties, copies, empty tables, clashing columns."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.llm import mapping as M
from fieldtrace.llm import packing as P
from fieldtrace.llm import quality as Q
from fieldtrace.llm.bpe import DEFAULT_VOCAB, Encoder, PairTable, count_tokens, encode_corpus, encode_pieces
from fieldtrace.llm.runs import collapse_runs

# ---- encoding

TEXTS = [
    None, "", " ", "\n\n\n  end  \t", "Hello world, it's   a  test's\nof lines\n\n", "naïve café — ſ ﬁ 😀😀 日本語", "<|endoftext|> x", "a" * 3000, "ab" * 700 + " " * 50,
    "x\x1c\x1dy\x85z q　​", "1234567890 12.5£ 1s. 1½d.", "'s'll'LL n’a",
]


def library_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCAB)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoding_equals_the_library():
    rng = random.Random(0)
    alphabet = "abcdefgh eE  \n.,;'’é1239ß—"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    assert encoded(Encoder(DEFAULT_VOCAB), texts) == library_ids(texts)


def test_forgetting_does_not_show():
    encoder = Encoder(DEFAULT_VOCAB, remembered=3)
    for text in TEXTS * 2:
        assert encoded(encoder, [text]) == library_ids([text])


def test_pieces_against_plain_merging():
    table = PairTable(DEFAULT_VOCAB)
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"theranding ") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    ids, counts = encode_pieces(table, pieces)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    for piece, mine in zip(pieces, got, strict=True):
        tokens = table.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        while len(tokens) > 1:
            ranks = table.rank(tokens[:-1], tokens[1:])
            if (ranks < 0).all():
                break
            at = int(np.where(ranks < 0, 1 << 40, ranks).argmin())
            tokens = np.concatenate([tokens[:at], [table.into[ranks[at]]], tokens[at + 2 :]])
        assert mine == tokens.tolist()


@pytest.mark.parametrize("size", [32_768, 32_769, 65_537, 200_000])
def test_unbroken_pieces_of_any_length(size):
    rng = random.Random(size)
    kinds = ["etaoinshrdlu", "0123456789", "!?-=*#.,", "日本語éßж"]
    texts = ["".join(rng.choice(kind) for _ in range(size // len(kind[0].encode()))) for kind in kinds]
    assert encoded(Encoder(DEFAULT_VOCAB), texts) == library_ids(texts)


def test_few_and_many_pieces_alike():
    table = PairTable(DEFAULT_VOCAB)
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"theranding") for _ in range(rng.randrange(30, 33))) for _ in range(20)]
    ids, counts = encode_pieces(table, pieces)
    assert ids.tolist() == [i for p in pieces for i in encode_pieces(table, [p])[0].tolist()]


DOCS = "doc_id BIGINT, text STRING, ids INT, _text INT, n_tokens INT"


def test_corpus(spark):
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(TEXTS)] + [(None, "x", 1, 2, 3), (0, None, 1, 2, 3)], DOCS)
    got = encode_corpus(df).collect()
    assert len(got) == len(TEXTS) + 2
    by_id = {r.doc_id: r.ids for r in got}
    assert [by_id[k] for k in range(len(TEXTS))] == library_ids(TEXTS)
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert all(sizes[k] == len(v) for k, v in by_id.items())
    assert encode_corpus(spark.createDataFrame([], DOCS)).schema["ids"].dataType == T.ArrayType(T.IntegerType())


# ---- mapping


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pigeonhole_join_misses_nothing(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    refs = [(k, word(rng.randrange(3, 14))) for k in range(40)]
    refs = [(k, r, 0, min(3, len(r) // 3), len(r)) for k, r in refs]
    typed = sorted({word(rng.randrange(1, 15)) for _ in range(150)})
    frame = spark.createDataFrame(refs, "behaviour_id INT, ref STRING, origin INT, k INT, n INT")
    got = M.pigeonhole_pairs(spark.createDataFrame([(t,) for t in typed], "typed STRING"), frame)
    found = {(r.typed, r.behaviour_id): r.d for r in got.collect()}
    want = {(t, i): d for t in typed for i, ref, _, k, _ in refs if (d := distance(t, ref)) <= k}
    assert found == want


LIST = [(1, "grazing", "GRZ", "Head low, eating grass"), (2, "standing still", "STD", "Upright, motionless"), (3, "ear flick", "EFL", "Ear twitch"), (4, "walking", "WLK", "Slow gait")]
REGISTER = "register_id BIGINT, Behaviour STRING, value STRING, behaviour_id INT, typed INT"


def mapped(spark, values):
    rows = spark.createDataFrame([(k, v, "x", 0, 0) for k, v in enumerate(values)], REGISTER)
    canonical = spark.createDataFrame(LIST, "behaviour_id INT, name STRING, code STRING, description STRING")
    got = M.map_values(rows, canonical, aliases={"standing still": "stood still"})
    out = [set() for _ in values]
    for r in got.collect():
        assert r.behaviour_id not in out[r.register_id]
        out[r.register_id].add(r.behaviour_id)
    return out


def test_values(spark):
    remarks = [("mostly ", ""), ("", " near gate"), ("", "; rain"), ("", " rain"), ("", " x3")]
    beside = {f"{a}{name}{b}": {k} for a, b in remarks for k, name, *_ in LIST}
    values = beside | {
        "grazing": {1}, " GRAZZING. ": {1}, "grz": {1}, "grazes then Stand Still": {1, 2}, "upright, motionless": {2}, "earflick; rain": {3}, "flicking ear": {3},
        "mostly walkng near gate": {4}, "Mostly EFL x12": {3}, "rain": {-1}, "near gate": {-1}, "grazing; rain; near gate": {1}, "seldom walking": {-1}, "slow gait": {4}, "walkie talkie broke": {-1}, "??": {-1}, None: set(), "  ": set(), "": set(), "stood still/EFL": {2, 3},
    }
    assert mapped(spark, list(values)) == list(values.values())
    assert mapped(spark, []) == []


def test_remarks_are_learned(spark):
    """What stands beside two kinds of entry is no remark with a support of three, nor is an entry itself."""
    canonical = spark.createDataFrame(LIST, "behaviour_id INT, name STRING, code STRING, description STRING")
    refs = M.references(canonical, aliases={}).cache()
    typed = ["grazing again", "walking again", "ear flick again", "grazing alone", "walking alone", "big grazing", "big walking", "big ear flick", "grazing walking", "ear flick walking", "efl walking"]
    parts = spark.createDataFrame([(t.split(),) for t in typed], "words ARRAY<STRING>")
    got = M.learn_remarks(M._spans(parts, 4), refs)
    assert sorted(map(tuple, got.collect())) == [("before", "big"), ("behind", "again")]


def test_misspellings_are_no_remarks(spark):
    """A misspelling that stands beside many kinds of entry keeps its meaning, wherever it stands; so do parts that mean something only together."""
    values = {"walking": {4}, "walkng": {4}, "upright, motionless": {2}, "ear flick; upright, motionless": {2, 3}, "grazing then walkng; upright, motionless": {1, 2, 4}}
    for k, name, *_ in LIST:
        values |= {f"{name}; walkng": {k, 4}, f"walkng then {name}": {k, 4}, f"{name}; walking": {k, 4}, f"{name}, upright, motionless": {k, 2}}
    assert mapped(spark, list(values)) == list(values.values())


def test_lone_remarks(spark):
    """A part near a reference string is a remark only where it is more frequent than that string."""
    beside = [("grazing", 1), ("walking", 4), ("ear flick", 3)]
    rows = [(f"{a} {t}", n, x.replace(" ", "")) for t in ("grzng", "wolkinc") for a, _ in beside for n, x in enumerate((a, t))] + [(f"grazing {k}", 0, "grazing") for k in range(3)]
    parts = spark.createDataFrame(rows, "value STRING, first INT, typed STRING")
    pairs = [("grzng", "grazing", 1, 0, 2), ("wolkinc", "wlkinc", 4, 0, 2), *[(x.replace(" ", ""), x.replace(" ", ""), k, 0, 0) for x, k in beside]]
    got = M.lone_remarks(parts, spark.createDataFrame(pairs, "typed STRING, ref STRING, behaviour_id INT, origin INT, d INT"))
    assert [r.typed for r in got.collect()] == ["wolkinc"]


def test_without_aliases(spark):
    rows = spark.createDataFrame([(1, "grazed"), (2, "frozen pose")], "register_id BIGINT, Behaviour STRING")
    canonical = spark.createDataFrame(LIST, "behaviour_id INT, name STRING, code STRING, description STRING")
    assert sorted(map(tuple, M.map_values(rows, canonical, aliases={}).collect())) == [(1, 1), (2, -1)]
    assert sorted(map(tuple, M.map_values(rows, canonical, aliases={"standing still": "frozen pose"}).collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, M.map_values(rows, canonical.limit(0)).collect())) == [(1, -1), (2, -1)]


def test_long_and_repeated_values(spark):
    assert mapped(spark, ["grazing"] * 3 + ["z" * 5000]) == [{1}] * 3 + [{-1}]


# ---- runs

BOUTS = "bout_id BIGINT, animal_id BIGINT, labels INT, lengths BIGINT, start_index BIGINT, chunk INT, run INT, stop INT"


def plain_runs(bouts):
    out = []
    for animal in sorted({b[1] for b in bouts}):
        last = None
        for _, _, label, length, start in sorted((b for b in set(bouts) if b[1] == animal), key=lambda b: (b[4], b[0])):
            if last is not None and label is not None and last[1] == label and start <= last[3] + 5:
                last[3], last[4], last[5] = max(last[3], start + length), last[4] + 1, last[5] + length
            else:
                last = [animal, label, start, start + length, 1, length]
                out.append(last)
    return sorted(map(tuple, out), key=str)


def collapsed(spark, bouts, **kw):
    df = spark.createDataFrame([(*b, 1, 2, 3) for b in bouts], BOUTS)
    return sorted((tuple(r) for r in collapse_runs(df, **kw).collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 9, 64, 100_000])
def test_runs_in_any_chunks(spark, chunk):
    rng = random.Random(chunk)
    bouts = [(k, rng.choice([1, 2]), rng.choice([0, 0, 0, 1, None]), rng.choice([0, 1, 4, 30, 200]), rng.randrange(1500)) for k in range(300)]
    bouts += [bouts[7]] * 20
    assert collapsed(spark, bouts, chunk=chunk) == plain_runs(bouts)


def test_run_reaching_over_a_shorter_one(spark):
    bouts = [(1, 1, 3, 1000, 0), (2, 1, 3, 10, 900), (3, 1, 3, 5, 950), (4, 1, 3, 5, 1006), (5, 1, 4, 5, 1010)]
    assert collapsed(spark, bouts, chunk=100) == [(1, 3, 0, 1000, 3, 1015), (1, 3, 1006, 1011, 1, 5), (1, 4, 1010, 1015, 1, 5)]


def test_runs_without_a_part(spark):
    df = spark.createDataFrame([(1, None, 1, 1, 1, 0, 0, 0), (None, 1, 1, 1, 1, 0, 0, 0), (2, 1, 1, None, 5, 0, 0, 0)], BOUTS)
    assert [tuple(r) for r in collapse_runs(df).collect()] == [(1, 1, 5, 5, 1, 0)]
    assert collapsed(spark, []) == []


# ---- packing


def test_buckets_are_optimal():
    rng = random.Random(4)
    for _ in range(20):
        sizes = sorted(rng.sample(range(1, 60), 6))
        counts = [rng.randrange(1, 50) for _ in sizes]

        def cost(bounds):
            low, total = 0, 0
            for b in bounds:
                n = sum(c for s, c in zip(sizes, counts, strict=True) if low < s <= b)
                total += -(-n // (64 // b))
                low = b
            return total

        best = min(cost([*c, sizes[-1]]) for r in range(3) for c in combinations(sizes[:-1], r))
        assert cost(P.choose_buckets(sizes, counts, 64, 3)) == best
    assert P.choose_buckets([], [], 64, 3) == []


def test_containers(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 7, 30, 64, 65, 200, None]) for _ in range(300)]
    df = spark.createDataFrame([(k, s, "x", 1) for k, s in enumerate(sizes)], "doc_id BIGINT, n_tokens BIGINT, bucket STRING, id INT")
    packed = P.pack_items(df, capacity=64, group_rows=40, buckets=4)
    got = packed.collect()
    whole, held = {}, {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.size
        held.setdefault(r.container, []).append(r.size)
        assert r.part == 0 or sizes[r.doc_id] > 64
        assert (r.container is None) == (r.size == 0)
    assert whole == {k: s or 0 for k, s in enumerate(sizes)}
    del held[None]
    assert max(map(sum, held.values())) <= 64
    # As many containers as the program counted, each with items of one bucket.
    rests = [r.size for r in got if 0 < r.size < 64]
    bounds = P.choose_buckets(*map(list, zip(*[(s, rests.count(s)) for s in set(rests)], strict=True)), 64, 4)
    want = sum(-(-sum(lo < s <= hi for s in rests) // (64 // hi)) for lo, hi in zip([0, *bounds], bounds, strict=False))
    assert len(held) == want + sum(r.size == 64 for r in got)
    assert all(sum(max(v) <= b for b in bounds) == sum(min(v) <= b for b in bounds) for v in held.values())
    row = P.fill(packed, capacity=64).first()
    assert (row.n_containers, row.tokens) == (len(held), sum(whole.values())) and row.fill == row.tokens / (64 * row.n_containers)


def test_containers_of_copies_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 20)] * 50 + [(None, 20)], "doc_id BIGINT, n_tokens BIGINT")
    held = [r.n for r in P.pack_items(df, capacity=64, group_rows=10).groupBy("container").agg(F.count("*").alias("n")).collect()]
    assert sorted(held) == [3] * 17
    assert P.pack_items(df.limit(0), capacity=64).count() == 0


# ---- text types

PROSE = "The old man said that he had been at the mill, and it was not known who would come to the town.\nWe have seen it since, but there is no more to be said of it than this.\n" * 4
TABLE = "9 48 9 30 2 31\n2 26 0 29 2 46\n5 47 3 54 3 43\n" * 8
NAMES = "W. Tarngate, W. Pelling, J. Halby, L.\nDunrow, K. Lamden, E. Fengate, A.\n" * 8
GARBLED = "}¬{: ▪—!n ▪ef «( @f t|i =□b\n°=¬ □  ¬] °:▪¬}:(«°^  I\n" * 8
REVERSED = "\n".join(line[::-1] for line in PROSE.split("\n"))


def test_types_without_labels(spark):
    texts = [PROSE] * 30 + [TABLE, NAMES, GARBLED, REVERSED] * 5 + [None, "", " \n\t "]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id BIGINT, text STRING, n INT, words STRING")
    got = {r.doc_id: r for r in Q.text_types(df).collect()}
    assert set(got) == set(range(50))
    assert {k for k, r in got.items() if r.text_type == "other"} == set(range(30, 50))
    assert got[0].mean_word_len > 3 and got[30].digit_words == 1.0 and got[0].common_words > 0.4
    assert Q.text_types(df.limit(0)).count() == 0


def test_sentences_in_capitals_are_prose(spark):
    texts = [PROSE] * 20 + [PROSE.upper()] * 3 + [TABLE, NAMES, GARBLED] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert {r.doc_id for r in Q.text_types(df).where("text_type = 'other'").collect()} == set(range(23, 35))


def test_common_words_of_each_language(spark):
    rows = [("en", "the man and the sea")] * 50 + [("FR", "la mer, et la nuit")] * 10 + [(None, "xx yy")] * 3 + [("de", "der Mond")] + [("en", None), ("fr", "")]
    df = spark.createDataFrame(rows, "lang STRING, text STRING")
    assert Q.common_words(df, share=0.5, least=0.03) == ["and", "et", "la", "man", "mer", "nuit", "sea", "the", "xx", "yy"]
    assert Q.common_words(df, share=0.5, least=0.03, longest=2) == ["et", "la", "xx", "yy"]
    assert Q.common_words(df.drop("lang"), share=0.5) == ["and", "man", "sea", "the"]
    assert Q.common_words(df.limit(0)) == []


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, PROSE * 2000), (2, TABLE), (2, TABLE)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in Q.text_statistics(df, common=["the", "that", "it", "to", "and", "been", "who", "no", "of", "would"]).collect()}
    assert got[1].spoken > 0.9 and got[2].spoken == 0.0 and got[2].digit_words == 1.0
    assert Q.text_statistics(df, common=[]).where("spoken > 0").count() == 0


def test_em_finds_the_better_function():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.6)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table, temper = Q.learn_accuracies([(tuple(p), int(n)) for p, n in zip(patterns.tolist(), counts, strict=True)])
    assert abs(prior - 0.6) < 0.05
    assert np.abs(table[:, 1, 1] - [0.95, 0.9, 0.85, 0.6]).max() < 0.05
    assert temper > 0.8
    assert Q.learn_accuracies([])[0] == 0.5


def test_functions_that_err_together_count_less():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    first = np.where(rng.random(4000) < 0.8, truth, ~truth)
    same = np.stack([first] * 3 + [np.where(rng.random(4000) < 0.9, truth, ~truth)] * 2, axis=1).astype(int)
    patterns, counts = np.unique(same, axis=0, return_counts=True)
    assert Q.learn_accuracies([(tuple(p), int(n)) for p, n in zip(patterns.tolist(), counts, strict=True)])[2] < 0.8
