from quire.llm.sentences import Words, corpus_words, sentence_ends, word_before

WORDS = Words({"no", "dr", "p.m"}, set())


def cut(text):
    out, at = [], 0
    for e in sentence_ends(text, WORDS):
        out.append(text[at:e].strip())
        at = e
    return out


def test_document_evidence_comes_first():
    # a word without a stop elsewhere is no abbreviation here, though corpus and list have it
    assert cut("There is no way. He said no. Xan came.") == ["There is no way.", "He said no.", "Xan came."]
    assert cut("He asked. See no. 5 and no. 6, no. Xan is late.") == ["He asked.", "See no. 5 and no. 6, no. Xan is late."]
    # long words: the document alone shows that this is one
    assert cut("In blorbic. 5 and blorbic. 6 it was. By blorbic. Xan it is.") == ["In blorbic. 5 and blorbic. 6 it was.", "By blorbic. Xan it is."]


def test_names_after_abbreviations(spark):
    assert cut("It met Dr. Stone. Ok.") == ["It met Dr. Stone.", "Ok."]
    assert cut("It ran at 5 p.m. Then it met Bo, who then left.") == ["It ran at 5 p.m.", "Then it met Bo, who then left."]
    docs = spark.createDataFrame([(f"All of it then ran on {i}. Then it slept.",) for i in range(6)] + [("They met Xan.",)], "t string")
    words = corpus_words(docs, "t")
    assert "then" in words.small and "xan" not in words.small
    assert len(sentence_ends("It ran at 5 p.m. Then it met Bo.", Words({"p.m"}, set(), words.small))) == 2
    assert len(sentence_ends("It ran at 5 p.m. Xan met Bo.", Words({"p.m"}, set(), words.small))) == 1


def test_the_list_comes_last(spark):
    docs = spark.createDataFrame([("The sec. It went. The fig. They go.",)] * 25, "t string")
    assert corpus_words(docs, "t").abbreviations >= {"sec", "fig"}  # short, and never without a stop
    docs = docs.limit(0).union(spark.createDataFrame([("One sec.\n\nA sec so. By sec. Xan came.",)] * 25, "t string"))
    words = corpus_words(docs, "t")
    assert "sec" in words.denied and "sec" not in words.abbreviations
    assert len(sentence_ends("By sec. Xan came.", words)) == 2 and len(sentence_ends("By sec. Xan came.", Words())) == 1


def test_long_words():
    # a word is taken whole, whatever its length
    assert word_before("by abcdefghijklmnopqrstuvwxyzabcdefgh. X", 37, 0) == "abcdefghijklmnopqrstuvwxyzabcdefgh"
    long = "blorbicvexolumnitrasquondapherixa"
    assert cut(f"In {long}. 5 and {long}. 6 it was. By {long}. Xan it is.") == [f"In {long}. 5 and {long}. 6 it was.", f"By {long}. Xan it is."]


def test_always_with_a_stop(spark):
    docs = spark.createDataFrame([("They met abteilungsltr. Xan there. They slept. So they slept on.",)] * 25, "t string")
    words = corpus_words(docs, "t")
    assert "abteilungsltr" in words.abbreviations and "slept" not in words.abbreviations
