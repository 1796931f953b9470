"""The sentence model on texts whose abbreviations, initials and numbers are known."""

import random

from loomset.functions import text
from loomset.operators import sentences

SCHEMA = "id long, lang string, text string"


def corpus():
    """Sentences of ordinary words; some hold an abbreviation, an initial or a number before a name. True ends are known."""
    rnd = random.Random(20)
    common = ["house", "river", "green", "walks", "often", "slowly", "under", "bridge", "people", "market", "window", "morning", "light", "paper"]
    names = ["Miller", "Okafor", "Lindqvist", "Tanaka", "Moreau"]
    starters = ["The", "It", "However", "They"]
    rows, truth = [], {}
    for i in range(300):
        out = []
        for _ in range(rnd.randrange(2, 6)):
            w = [rnd.choice(starters)] + [rnd.choice(common) for _ in range(rnd.randrange(4, 9))]
            kind = rnd.randrange(6)
            put = {0: ["Dr.", rnd.choice(names)], 1: ["J.", rnd.choice(names)], 2: ["e.g.", rnd.choice(common)], 3: ["room", f"{rnd.randrange(1, 99)}.", rnd.choice(names)]}.get(kind, ["it", "is", "the"])
            at = rnd.randrange(1, len(w))
            w[at:at] = put
            out.append(" ".join(w) + rnd.choice([".", ".", ".", "!", "?"]))
        rows.append((i, "en", rnd.choice([" ", "\n"]).join(out)))
        truth[i] = out
    return rows, truth


def test_boundaries(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = sentences.trained(df)
    types = {r.typ: r for r in model.types.collect()}
    assert types["dr"].abbreviation and types["e.g"].abbreviation and not types["bridge"].abbreviation
    assert types["the"].starter and types["the"].low and not types["miller"].low
    got = {r.id: [s.word for s in r.sentences] for r in sentences.sentences(df, model).collect()}
    assert got == truth
    once = {r.id: text_of(r.words) for r in sentences.words_of_sentences(df, model).collect()}
    assert once == {i: t for i, _, t in rows}


def text_of(pairs):
    return "".join(p.word + p.conn for p in pairs)


def test_edges(spark):
    rows, _ = corpus()
    model = sentences.trained(spark.createDataFrame(rows, SCHEMA))
    odd = [(1, "en", None), (2, "en", ""), (3, "en", " \n "), (4, "xx", "One. two. Three!"), (5, None, "It is.\n\nThe end"), (6, "en", "  Dr. Miller. "), (6, "en", "  Dr. Miller. "), (7, "en", "Wait... The end... of it"), (8, "en", '"Yes." They (it?) go.')]
    df = spark.createDataFrame([(*r, 1, 2) for r in odd], SCHEMA + ", typ int, next int")
    out = sentences.sentences(df, model)
    assert out.columns == ["id", "lang", "text", "typ", "next", "sentences"] and out.count() == len(odd)
    got = {r.id: None if r.sentences is None else [tuple(s) for s in r.sentences] for r in out.collect()}
    assert got[1] is None and got[2] == [] and got[3] == []
    assert got[4] == [("One.", " "), ("two.", " "), ("Three!", "")]
    assert got[5] == [("It is.", "\n\n"), ("The end", "")]
    assert got[6] == [("Dr. Miller.", " ")]
    assert got[7] == [("Wait...", " "), ("The end... of it", "")]
    assert got[8] == [('"Yes."', " "), ("They (it?)", " "), ("go.", "")]
    words = {r.id: [w.word for w in r.words] for r in sentences.words_of_sentences(df.where("id = 6"), model).collect()}
    assert words == {6: ["Dr.", "Miller", "."]}
    none = spark.createDataFrame([], SCHEMA)
    empty = sentences.trained(none)
    assert empty.types.count() == 0 and sentences.sentences(none, empty).count() == 0
    assert sentences.sentences(df.where("id = 4"), empty).first().sentences[0].word == "One."


def test_pieces_of_treebank(spark):
    """Cut piece by piece as the whole text would be."""
    odd = ["", "  a", "can't stop: won't, 'tis \"so\" (he said).", "cannot CANNOT gonna", "word: 5:30 x,y 1,000 , end,", "it's John's. they'll", "a -- b...c; $5% [x] {y} <z>", "end.) Next 'quoted' d'ye more'n", "tail:", "Ünï. çö", "it's"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in odd], "text string")
    marked = F.regexp_replace("text", text.SENTENCE, f"$1{text.END}$2")
    whole = F.transform(F.regexp_extract_all(text.treebank_cut(marked), F.lit(text.TOKEN), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, text.TOKEN, 1).alias("word"), F.regexp_extract(x, text.TOKEN, 2).alias("conn")))
    for r in df.select("text", whole.alias("a"), text.treebank_tokens(marked).alias("b")).collect():
        assert r.a == r.b, r.text
