"""Numbers of a chunk's words, which one pass over its texts gives."""

from prismtext.llm import pieces


def test_texts_are_numbered_in_one_pass():
    texts = ["b a b", None, "", "a\nb  c", " lead", "é a"]
    words, places, first = pieces.numbered(texts)
    assert words == sorted({k for t in texts for k in pieces.keys(t)})
    assert [[words[p] for p in places[a:z]] for a, z in zip(first, first[1:])] == [pieces.keys(t) for t in texts]
    words, places, first = pieces.numbered([None])
    assert (words, places.tolist(), first.tolist()) == ([], [], [0, 0])
