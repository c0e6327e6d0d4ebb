import random

from marlstone.llm import splitting as P


def text_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + (". " if i % 13 == 12 else " "))
        if i % 97 == 96:
            out.append("\n\n")
    return "".join(out)


def test_pieces_are_under_the_limit_overlap_exactly_and_restore_the_text():
    for seed, (most, overlap) in enumerate([(100, 15), (60, 0), (40, 39), (10, 3)]):
        text = text_of(1500, seed)
        spans, pieces = P.cuts(text, most, overlap)
        assert all(end - first <= most for first, _, end in pieces)
        assert all(new - first == overlap for first, new, _ in pieces[1:])
        assert pieces[0][1] == 0 and pieces[-1][2] == len(spans)
        assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))


def test_cuts_lie_at_natural_boundaries():
    text = text_of(3000)
    spans, pieces = P.cuts(text, 120, 10)
    ranks = P.boundaries(text, spans)
    assert all(ranks[end - 1] <= 1 for _, _, end in pieces)


def test_an_edit_alters_neighbouring_pieces_only():
    text = text_of(6000)
    words = text.split(" ")
    edited = " ".join([*words[:3000], "inserted", "words", *words[3000:]])
    def bodies(t):
        spans, pieces = P.cuts(t, 100, 10)
        return [t[spans[new][0] : spans[end - 1][1]] for _, new, end in pieces]
    a, b = bodies(text), bodies(edited)
    assert len(set(a) - set(b)) <= 8 and a[:20] == b[:20] and a[-20:] == b[-20:]


def test_text_without_boundaries_is_cut_between_words():
    spans, pieces = P.cuts("w " * 500, 50, 5)
    assert all(end - first <= 50 for first, _, end in pieces)


CHUNKS = "chunk_id string, chunk_type string, text string, token_count int, most int, overlap string"
LIMITS = "chunk_type string, max_tokens int, overlap_tokens int"


def test_table_cases(spark):
    rows = [("a", "prose", "w " * 25, 3, 1, "x"), ("a", "prose", "w " * 25, 3, 1, "x"), ("b", "prose", "w w", None, 1, "x"), ("c", "none", "w " * 99, 1, 1, "x"),
            ("d", "prose", None, 1, 1, "x"), ("e", "prose", " \t\n", 1, 1, "x"), ("f", None, "w", 1, 1, "x"), (None, "prose", "w " * 25, 3, 1, "x"), ("g", "prose", "w " * 11, 1, 1, "x")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    limits = spark.createDataFrame([("prose", 10, 2), ("prose", 10, 2), ("odd", None, None)], LIMITS)
    assert {r.chunk_id for r in P.oversized(chunks, limits).collect()} == {"a", "g"}
    got = [r for r in P.pieces(chunks, limits).collect() if r.chunk_id == "a"]
    assert len(got) == got[0].n_pieces and max(r.token_count for r in got) <= 10
    assert {r.chunk_id for r in P.pieces(chunks, limits).where("n_pieces = 1").collect()} == {"b", "c", "f"}
    assert P.pieces(chunks.where("false"), limits).count() == 0
    assert P.oversized(chunks, limits.where("false")).count() == 0
