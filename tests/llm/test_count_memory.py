"""The memory of counted words: frequent words stay when it is full."""

from sparktext.llm import bpe


def test_frequent_words_are_counted_once_though_the_memory_fills_up(monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED", 10)
    met = []

    def length(word):
        met.append(word)
        return len(word)

    counts = bpe._Counts(length)
    for i in range(100):
        assert counts["often"] == 5 and counts[f"rare{i}"] == len(f"rare{i}")
    assert met.count("often") == 1
    assert len(counts) <= 10 and len(counts.earlier) <= 10


def test_pieces_of_letters_share_the_memory_of_words(monkeypatch):
    import public_tokenizers

    known = bpe.Vocabulary(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["that that*** (that) that,,that", "naïve*** 12,5 naïve", "x" * 80 + "*** ñandú!"]
    assert [known.count(t) for t in texts] == [len(known.encode(t).split()) for t in texts]
    assert "that" in known.counts and "***" in known.sign_counts
