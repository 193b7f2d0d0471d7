"""A text whose chunks, new ones and known ones together, exceed the table."""

from gleanery.llm import pieces, queries


def test_more_chunks_than_the_table(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 3)
    t = pieces.ChunkTable(queries.piece_model())
    for texts in (["a b c d"], ["a e f g h"], ["a"], ["e f", "a i j k"], ["k a"]):
        want = [(" ".join(map(str, ids)), len(ids), s) for s in texts for ids in [t.sp.encode(s, add_eos=True)]]
        assert list(t.encode_batch(texts)) == want
