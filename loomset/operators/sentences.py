"""Sentence boundaries learned from the texts themselves, without labels.

Which words with a full stop are abbreviations, which word pairs belong together across a full stop and which words
like to begin sentences follows from counts alone, by likelihood ratios, as Kiss and Strunk describe (Unsupervised
Multilingual Sentence Boundary Detection, 2006). `counted` is the one pass over the texts: it sums words with what
stands before and after them. All else is done on distinct words. Models are tables, by language; texts meet
them in joins on (language, word, next word), which Spark broadcasts where they turn out small.

A boundary follows a word that ends in ! or ?, a word with a full stop that is no abbreviation, initial or number, and
dots before a capital letter. After abbreviations, initials and numbers one follows only before a capitalised word that
begins sentences often, or that is seen in lower case and never capitalised inside a sentence, and only
if the two are no collocation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import END, bound, tasks_for, treebank_tokens
from loomset.plans.lineage import materialised

WHITE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
OPENING, CLOSING = "\"'([{«„“‘", "\"')]}»”’"


@dataclass(frozen=True)
class Thresholds:
    """Of the likelihood ratios."""

    abbreviation: float = 0.3
    collocation: float = 7.88
    starter: float = 30.0


@dataclass(frozen=True)
class Model:
    """types: lang, typ, n, dotted, score, abbreviation, low (seen in lower case), inner (capitalised inside a sentence), starter.
    pairs: lang, typ, next (types that belong together across a full stop)."""

    types: DataFrame
    pairs: DataFrame


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def core(word: Column) -> Column:
    """Without quotes and brackets around it."""
    return F.ltrim(F.rtrim(word, F.lit(CLOSING)), F.lit(OPENING))


def stop(word: Column) -> Column:
    """dots, dot, mark (! or ?) or nothing: how a word's core ends."""
    end = core(word)
    return F.when(end.endswith(".."), "dots").when(end.endswith("."), "dot").when(F.right(end, F.lit(1)).isin("!", "?"), "mark").otherwise("")


def typed(word: Column) -> Column:
    """The word in lower case without the marks at its end; # for a number."""
    base = F.rtrim(core(word), F.lit(".,;:!?"))
    return F.when(base.rlike(r"^[-+]?[0-9][0-9.,]*$"), "#").otherwise(F.lower(base))


def capital(word: Column) -> Column:
    first = F.substring(core(word), 1, 1)
    return first != F.lower(first)


def counted(texts: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """lang, word, inner (not at the text's start, nor after a mark or a quote), next (of words with a full stop; null at the end), n."""
    inner = lambda w, i: F.coalesce((i > 0) & ~F.right(F.get(w, i - 1), F.lit(1)).isin(*".!?:", *CLOSING), F.lit(False))
    each = bound(words(F.col(text)), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), inner(w, i).alias("inner"), F.when(F.contains(x, F.lit(".")), F.get(w, i + 1)).alias("next"))))
    rows = texts.select((F.col(lang) if lang else F.lit("")).alias("lang"), each.alias("__each"))
    return rows.select("lang", F.explode("__each").alias("x")).groupBy("lang", "x.word", "x.inner", "x.next").agg(F.count("*").alias("n"))


def log_bernoulli(k: Column, n: Column, p: Column) -> Column:
    """Of k successes in n trials of probability p; 0 * log 0 is 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def pair_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """How much likelier it is that b depends on a before it (Dunning's ratio)."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    apart = log_bernoulli(both, a, p) + log_bernoulli(b - both, n - a, p)
    return 2 * (log_bernoulli(both, a, p1) + log_bernoulli(b - both, n - a, p2) - apart)


def trained(texts: DataFrame, text: str = "text", lang: str | None = "lang", limits: Thresholds = Thresholds()) -> Model:
    """The model of texts, for each language. Null texts count for nothing; a null language is one of its own."""
    seen = materialised(counted(texts, text, lang))
    seen = seen.withColumns({"typ": typed(F.col("word")), "stop": stop(F.col("word")), "capital": capital(F.col("word"))})
    dotted = F.col("stop") == "dot"
    sums = seen.groupBy("lang", "typ").agg(
        F.sum("n").alias("n"), F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("dotted"),
        F.max(~F.col("capital")).alias("low"), F.max(F.col("capital") & F.col("inner")).alias("inner"),
    )
    totals = sums.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("dotted").alias("all_dotted"))
    same = lambda a, b, *more: [F.expr(f"{a}.{c} <=> {b}.{c}") for c in ("lang", *more)]
    types = sums.alias("s").join(F.broadcast(totals).alias("t"), same("s", "t")).select("s.*", "all", "all_dotted")  # one row for each language
    n, k = F.col("n").cast("double"), F.col("dotted").cast("double")
    ratio = 2 * (log_bernoulli(k, n, F.lit(0.99)) - log_bernoulli(k, n, F.col("all_dotted") / F.col("all")))
    letters = F.length(F.replace("typ", F.lit("."), F.lit(""))).cast("double")
    inside = F.length("typ") - letters + 1
    score = ratio * F.exp(-letters) * inside * F.pow(letters, k - n)
    typical = F.col("typ").rlike(r"^\p{L}") & (F.col("dotted") > 0) & (F.col("all_dotted") < F.col("all"))
    types = types.withColumn("score", F.when(typical, score)).withColumn("abbreviation", F.coalesce(F.col("score") >= limits.abbreviation, F.lit(False)))
    types = materialised(types)
    # types after full stops, by whether that is an abbreviation's, an initial's or a number's
    after = seen.where(dotted & F.col("next").isNotNull()).select("lang", "typ", typed(F.col("next")).alias("next"), "n").groupBy("lang", "typ", "next").agg(F.sum("n").alias("both"))
    after = after.alias("a").join(types.select("lang", "typ", "abbreviation", F.col("dotted").alias("n_typ")).alias("s"), same("a", "s", "typ")).select("a.*", "n_typ", special(F.col("a.typ"), F.col("abbreviation")).alias("special"))
    after = materialised(after)
    breaks = after.where(~F.col("special"))
    of_lang = breaks.groupBy("lang").agg(F.sum("both").alias("breaks"))
    first = breaks.groupBy("lang", "next").agg(F.sum("both").alias("both"))
    known = types.select("lang", F.col("typ").alias("next"), F.col("n").alias("n_next"), "all")
    first = first.alias("f").join(F.broadcast(of_lang).alias("o"), same("f", "o")).join(known.alias("k"), same("f", "k", "next")).select("f.*", "breaks", "n_next", "all")
    number = lambda c: F.col(c).cast("double")
    often = (pair_ratio(number("breaks"), number("n_next"), number("both"), number("all")) >= limits.starter) & (number("both") / number("breaks") > number("n_next") / number("all"))
    starters = first.where(often & F.col("next").rlike(r"^\p{L}+$")).select("lang", F.col("next").alias("typ"), F.lit(True).alias("starter"))
    pairs = after.where("special").alias("p").join(known.alias("k"), same("p", "k", "next")).select("p.*", "n_next", "all")
    bound = (pair_ratio(number("n_typ"), number("n_next"), number("both"), number("all")) >= limits.collocation) & (number("both") / number("n_typ") > number("n_next") / number("all"))
    pairs = pairs.where(bound).select("lang", "typ", "next")
    types = types.alias("s").join(starters.alias("f"), same("s", "f", "typ"), "left").select("s.lang", "s.typ", "n", "dotted", "score", "abbreviation", "low", "inner", F.coalesce("starter", F.lit(False)).alias("starter"))
    return Model(materialised(types), materialised(pairs))


def special(typ: Column, abbreviation: Column) -> Column:
    """Whose full stop need not end a sentence: abbreviations, initials, numbers."""
    return abbreviation | (typ == "#") | typ.rlike(r"^\p{L}$")


def decided(contexts: DataFrame, model: Model) -> DataFrame:
    """lang, word, next of the contexts (lang, word, next; each once) after whose word a sentence ends."""
    c = contexts.withColumns({"typ": typed(F.col("word")), "stop": stop(F.col("word")), "next_typ": typed(F.col("next")), "capital": capital(F.col("next"))})
    same = lambda name, *on: [F.expr(f"c.lang <=> {name}.lang"), *(F.expr(f"c.{x} = {name}.{y}") for x, y in on)]
    c = c.alias("c").join(model.types.alias("s"), same("s", ("typ", "typ")), "left").select("c.*", "abbreviation")
    c = c.alias("c").join(model.types.alias("f"), same("f", ("next_typ", "typ")), "left").select("c.*", "low", "inner", "starter")
    c = c.alias("c").join(model.pairs.withColumn("bound", F.lit(True)).alias("p"), same("p", ("typ", "typ"), ("next_typ", "next")), "left").select("c.*", "bound")
    no = F.lit(False)
    begins = F.col("capital") & (F.coalesce("starter", no) | (F.coalesce("low", no) & ~F.coalesce("inner", no)))
    ends = F.when(F.col("stop") == "mark", True).when(F.col("stop") == "dots", F.col("capital"))
    ends = ends.when(special(F.col("typ"), F.coalesce("abbreviation", no)), begins & F.col("bound").isNull()).otherwise(F.col("stop") == "dot")
    return c.where(ends).select("lang", "word", "next")


def boundaries(texts: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """texts with `__ends`: the positions, ascending, of the words after which a sentence ends and another word follows (null: none).

    Texts are named by a digest of language and text, so rows of equal ones are looked at once, and dealt by it."""
    names = texts.columns
    language = F.col(lang) if lang else F.lit("")
    named = F.concat(F.coalesce(F.concat(F.lit("l"), language), F.lit("n")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))
    rows = texts.withColumn("__lang", language).withColumn("__digest", F.sha2(named, 256))
    may = lambda x: F.right(F.rtrim(x, F.lit(CLOSING)), F.lit(1)).isin(".", "!", "?")
    each = bound(words(F.col(text)), lambda w: F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"), F.get(w, i + 1).alias("next"))))
    each = F.filter(each, lambda x: may(x["word"]) & x["next"].isNotNull())
    found = rows.select(F.col("__lang").alias("lang"), "__digest", F.explode(each).alias("x")).select("lang", "__digest", "x.*")
    ends = decided(found.select("lang", "word", "next").distinct(), model)
    marks = found.alias("c").join(ends.alias("e"), [F.expr("c.lang <=> e.lang"), F.expr("c.word = e.word"), F.expr("c.next = e.next")], "left_semi")
    marks = marks.groupBy("__digest").agg(F.array_sort(F.collect_set("at")).alias("__ends"))
    out = rows.repartition(tasks_for(texts, text), "__digest").alias("r").join(marks.alias("m"), F.expr("r.__digest = m.__digest"), "left")
    return out.select(*(F.col(f"r.`{n}`") for n in names), "__ends")


def pieces(text: Column, ends: Column) -> Column:
    """The sentences with the white space after each, as strings; white space before the first word is lost."""
    whole = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]+{WHITE}*"), F.lit(0))

    def cut(w: Column, last: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(last, i - 1) + 1)
        return F.transform(last, lambda e, i: F.array_join(F.slice(w, start(i) + 1, e - start(i) + 1), ""))

    found = bound(whole, lambda w: bound(F.concat(F.coalesce(ends, F.array().cast("array<int>")), F.array(F.size(w) - 1)), lambda last: cut(w, last)))
    return F.when(text.isNotNull(), F.filter(found, lambda s: s != ""))


def sentences(texts: DataFrame, model: Model, text: str = "text", lang: str | None = "lang", into: str = "sentences") -> DataFrame:
    """texts with an array of (word: the sentence, conn: the white space after it), which make the text again. Null text: null."""
    cut = lambda s: F.struct(F.rtrim(s, F.lit(SPACES)).alias("word"), F.substring(s, F.length(F.rtrim(s, F.lit(SPACES))) + 1, F.length(s)).alias("conn"))
    rows = boundaries(texts, model, text, lang).withColumn("__pieces", pieces(F.col(text), F.col("__ends")))
    return rows.withColumn(into, F.transform("__pieces", cut)).drop("__ends", "__pieces")


def words_of_sentences(texts: DataFrame, model: Model, text: str = "text", lang: str | None = "lang", into: str = "words") -> DataFrame:
    """texts with an array of (word, conn): Treebank tokens of the model's sentences, each with the white space after it."""
    rows = boundaries(texts, model, text, lang).withColumn("__pieces", pieces(F.col(text), F.col("__ends")))
    marked = F.transform("__pieces", lambda s: F.concat(F.rtrim(s, F.lit(SPACES)), F.lit(END), F.substring(s, F.length(F.rtrim(s, F.lit(SPACES))) + 1, F.length(s))))
    rows = rows.withColumn("__pieces", F.when(F.col(text).isNotNull(), F.array_join(marked, "")))
    return rows.withColumn(into, treebank_tokens(F.col("__pieces"))).drop("__ends", "__pieces")
