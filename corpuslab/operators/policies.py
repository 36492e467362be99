"""Decisions about single edits and places: case edits, word forms, commas, votes of a rewriter, model labels, mixes of systems.

Parts of speech and lemmas come as columns from the lexicon joins of :mod:`corpuslab.operators.morphology`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import cleaning as C
from corpuslab.functions import text as T
from corpuslab.operators import evaluation, scoring

#: Parts of speech that are no title after a comma, marks of names, and words that people put a comma before or after.
LOWERABLE = ["ADJF", "ADJS", "PRTF", "PRTS", "VERB", "INFN", "ADVB", "PRED", "NPRO", "GRND"]
NAMES = ["Name", "Surn", "Patr", "Geox", "Orgn", "Abbr", "Trad"]
CONJUNCTIONS = ["и", "или"]
INSTRUMENTAL = ["путем", "путём", "посредством", "согласно", "благодаря", "вследствие"]
OPENING = ["при", "после", "для", "в", "во", "на"]
#: Pairs of words that are written together or apart by their meaning, and what follows them when apart.
PAIRS = [("так", "же"), ("то", "же"), ("в", "виду"), ("за", "то"), ("по", "этому"), ("в", "течение"), ("в", "течении")]
APART = [("так", "же", "как"), ("так", "же", "же"), ("так", "же", "самое"), ("то", "же", "как"), ("то", "же", "же"), ("то", "же", "самое")]
#: Changes that a form label names, in this order.
CATEGORIES = {"case": ["nomn", "gent", "datv", "accs", "ablt", "loct"], "number": ["sing", "plur"], "gender": ["masc", "femn", "neut"], "person": ["1per", "2per", "3per"]}


def _in(values: list[str], column: Column) -> Column:
    return F.coalesce(column.isin(values), F.lit(False))


def after_comma_word(text: Column, start: Column, word: Column, pos: Column, grammemes: Column) -> Column:
    """A capitalised word of four letters or more right after a comma whose best parse is no noun and no name."""
    behind = F.substr(text, F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2))) == ", "
    plain = (F.length(word) >= 4) & word.rlike(r"(?U)^\p{Lu}\p{Ll}+$")
    return behind & plain & _in(LOWERABLE, pos) & ~F.coalesce(F.arrays_overlap(grammemes, F.array(*[F.lit(n) for n in NAMES])), F.lit(False))


def lowered(word: Column, fix: Column) -> Column:
    """An edit that lowers the first letter and nothing else."""
    return word.rlike(r"(?U)^\p{Lu}") & (fix == F.concat(F.lower(F.left(word, F.lit(1))), F.substr(word, F.lit(2))))


def title_like(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` (keys, word_no, word, gap: what follows the word) with ``title_like``: a neighbour over plain space, but not
    the first word, is capitalised too."""
    w = Window.partitionBy(*keys).orderBy("word_no")
    capital = lambda c: F.coalesce(c.rlike(r"(?U)^\p{Lu}"), F.lit(False))
    before = capital(F.lag("word").over(w)) & (F.trim(F.lag("gap").over(w)) == "") & (F.col("word_no") > 1)
    after = capital(F.lead("word").over(w)) & (F.trim("gap") == "")
    return words.withColumn("title_like", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


#: Options of :func:`accepted_case`; a policy is a dict that overrides some.
CASE_OPTIONS = {"quote_guard": True, "after_comma_only": False, "after_comma": False, "title_guard": False, "mid_up": False, "start_up": False, "confirm": None}


def accepted_case(options: dict) -> Column:
    """Whether a case edit passes: rows have kind (mid-down, mid-up, start-up), word, body, in_quotes, fits (the spelling head's
    repair applies), after_comma, title_like and p (of the head, may be null). Unknown options are refused."""
    unknown = set(options) - set(CASE_OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {', '.join(sorted(unknown))}; known: {', '.join(CASE_OPTIONS)}")
    o = CASE_OPTIONS | options
    c = F.col
    if o["after_comma_only"]:
        down = c("after_comma")
    else:
        down = c("fits") | (c("after_comma") & F.lit(o["after_comma"]))
        down = down & ~c("title_like") if o["title_guard"] else down
    up = c("fits") & F.lit(o["mid_up"])
    start = F.lit(o["start_up"]) & F.rtrim(c("body")).rlike("[.!?]$")
    out = F.when(c("kind") == "mid-down", down).when(c("kind") == "mid-up", up).otherwise(start) & ~T.protected(c("word"))
    out = out & ~c("in_quotes") if o["quote_guard"] else out
    return out & F.coalesce(c("p") >= o["confirm"], F.lit(False)) if o["confirm"] is not None else out


def case_variants(edits: DataFrame, variants: dict[str, dict], verdict: str = "verdict") -> DataFrame:
    """(variant, n, n_right, n_false) of policies given as data; the edits are read once."""
    sums = [F.struct(F.lit(name).alias("variant"), *[F.count_if(accepted_case(o) & ok).alias(n) for n, ok in (("n", F.lit(True)), ("n_right", F.col(verdict) == "exact"), ("n_false", F.col(verdict) == "false"))]) for name, o in variants.items()]
    return edits.agg(F.array(*sums).alias("v")).select(F.inline("v"))


def spurious_comma(position: Column, first: Column, following: Column, pos: Column, next_pos: Column) -> Column:
    """Whether people put a wrong comma behind a word (``position`` in its sentence, ``first`` word of it): before "и" and the
    like, after an opening with a preposition, between a subject and its verb."""
    opened = position.between(1, 6) & _in(OPENING, F.lower(first))
    return _in(CONJUNCTIONS + INSTRUMENTAL, F.lower(following)) | opened | F.coalesce((pos == "NOUN") & (next_pos == "VERB"), F.lit(False))


def previous_group(pos: Column) -> Column:
    """Coarse class of the word before a gap."""
    return F.when(pos.isin("NOUN", "ADJ", "VERB", "CONJ"), pos).otherwise("rest")


def form_label(a: Column, b: Column) -> Column:
    """``category:value`` pairs, joined by ``|``, that lead from the grammemes ``a`` to ``b``; null if none differs."""
    parts = []
    for name, values in CATEGORIES.items():
        pick = lambda g, v=values: F.get(F.filter(g, lambda x: x.isin(v)), F.lit(0))  # noqa: E731, B023
        parts.append(F.when(pick(b).isNotNull() & ~pick(a).eqNullSafe(pick(b)), F.concat(F.lit(f"{name}:"), pick(b))))
    label = F.array_join(F.array(*parts), "|")
    return F.when(label != "", label)


def form_edits(pairs: DataFrame, lexicon: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``label``: the form label from word ``a`` to word ``b`` of the same lemma and part of speech; null for
    equal words, another case of the first letter, or no common lemma. The most probable parses come first."""
    x = lexicon.select(F.col("form").alias("_a"), F.col("lemma").alias("_l"), F.col("pos").alias("_p"), F.col("grammemes").alias("_x"), F.col("score").alias("_sx"))
    y = lexicon.select(F.col("form").alias("_b"), F.col("lemma").alias("_m"), F.col("pos").alias("_q"), F.col("grammemes").alias("_y"), F.col("score").alias("_sy"))
    fold = lambda c: F.translate(F.lower(c), "ё", "е")
    capital = lambda c: c.rlike(r"(?U)^\p{Lu}")
    both = pairs.select(a, b).distinct().where((fold(F.col(a)) != fold(F.col(b))) & (capital(F.col(a)) == capital(F.col(b))))
    both = both.join(x, F.lower(a) == F.col("_a")).join(y, (F.lower(b) == F.col("_b")) & (F.col("_l") == F.col("_m")) & (F.col("_p") == F.col("_q")))
    both = both.withColumn("_label", form_label(F.col("_x"), F.col("_y"))).where("_label is not null")
    best = both.groupBy(a, b).agg(F.min_by("_label", F.struct(-F.col("_sy"), -F.col("_sx"), "_label")).alias("label"))
    return pairs.join(best, [a, b], "left").select(*pairs.columns, "label")


def same_forms(before: Column, after: Column, lemmas: Column) -> Column:
    """Two texts with the same words in other forms: as many words, the same marks, the same case of first letters, and a
    common lemma of each pair. ``lemmas``: a map from lower-case words to arrays of lemmas."""
    a, b = T.words(before), T.words(after)
    marks = lambda t: F.replace(F.regexp_replace(t, T.WORD, ""), F.lit(" "), F.lit(""))
    capital = lambda w: w.rlike(r"(?U)^\p{Lu}")
    fits = lambda x, y: (capital(x) == capital(y)) & F.coalesce(F.arrays_overlap(lemmas[F.lower(x)], lemmas[F.lower(y)]), F.lit(False))
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & (marks(before) == marks(after)) & F.forall(F.zip_with(a, b, fits), lambda ok: F.coalesce(ok, F.lit(False)))


def ambiguous_pairs(words: DataFrame, keys: list[str], pairs: list[tuple[str, str]] = PAIRS, apart: list[tuple[str, str, str]] = APART) -> DataFrame:
    """Neighbouring words that are written together or apart by meaning, with ``apart``: what follows says that they are meant apart."""
    spark, w = words.sparkSession, Window.partitionBy(*keys).orderBy("word_no")
    rows = words.withColumns({"second": F.lower(F.lead("word").over(w)), "third": F.lower(F.lead("word", 2).over(w))}).withColumn("first", F.lower("word"))
    listed = rows.join(F.broadcast(spark.createDataFrame(pairs, "first string, second string")), ["first", "second"])
    known = spark.createDataFrame([(*x, True) for x in apart], "first string, second string, third string, _apart boolean")
    out = listed.join(F.broadcast(known), ["first", "second", "third"], "left")
    return out.select(*words.columns, "second", F.coalesce("_apart", F.lit(False)).alias("apart"))


def rewriter_findings(edits: DataFrame, levels: dict[str, str], seen: DataFrame, keys: list[str], votes: dict[str, tuple[str, str]]) -> DataFrame:
    """Findings of a rewriter's edits (keys, class, start, end, before, after): trimmed to what differs; at the level of their
    class, or, for a class without one, as errors where an earlier finding (``seen``: keys, level, rule, start, end, fix) of the
    rule and level that ``votes`` names for the class has the same place and fix; all others are left out."""
    cut = C.trimmed(F.col("before"), F.col("after"))
    rows = edits.withColumn("_c", cut).withColumns({"_start": F.col("start") + F.col("_c.skip"), "fix": F.col("_c.after")})
    rows = rows.withColumn("_end", F.col("_start") + F.length("_c.before")).select(*keys, "class", F.col("_start").cast("int").alias("start"), F.col("_end").cast("int").alias("end"), "fix")
    by_class = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]) if levels else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("level", by_class[F.col("class")])
    sure = rows.where("level is not null")
    out = sure
    for name, (rule, level) in votes.items():
        known = seen.where((F.col("rule") == rule) & (F.col("level") == level))
        asked = rows.where(F.col("level").isNull() & (F.col("class") == name)).withColumn("level", F.lit("error"))
        out = out.union(evaluation.voted(asked, known, [*keys, "start", "end", "fix"]).select(*sure.columns))
    return out.withColumn("rule", F.concat(F.lit("REWRITE_"), F.upper("class"))).drop("class")


def form_findings(predictions: DataFrame, violations: DataFrame, keys: list[str], error_at: float, check_at: float) -> DataFrame:
    """Findings of a form head (keys, word_no, fix, p): an error or check by its probability, none where the new form would
    break a grammar rule (``violations``: keys, word_no)."""
    level = F.when(F.col("p") >= error_at, "error").when(F.col("p") >= check_at, "check")
    return predictions.withColumn("level", level).where("level is not null").join(violations.select(*keys, "word_no").distinct(), [*keys, "word_no"], "left_anti")


def mixed_systems(words_of: DataFrame, commas_of: DataFrame, keys: list[str]) -> DataFrame:
    """Words of one system with the commas of another (both keys, words, commas as arrays), where both have as many words;
    else the first one as it is. ``agreed`` tells which."""
    other = commas_of.select(*keys, F.col("commas").alias("_commas"), F.size("words").alias("_n"))
    rows = words_of.join(other, keys, "left").withColumn("agreed", F.coalesce(F.size("words") == F.col("_n"), F.lit(False)))
    used = F.when(F.col("agreed"), F.col("_commas")).otherwise(F.col("commas"))
    text = F.array_join(F.zip_with("words", used, lambda w, c: F.concat(w, F.when(c, ",").otherwise(""))), " ")
    return rows.select(*keys, text.alias("text"), "agreed")


def earlier_passes(predictions: DataFrame, keys: list[str], how: str, models: list[str]) -> DataFrame:
    """One probability a place after all members of an ensemble have passed; only the last pass speaks. ``predictions``: keys, model, p."""
    return scoring.combine(predictions.where(F.col("model").isin(models)), keys, how, len(models))


def edit_features(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, n): counters of what edits (before, after, place) are like."""
    x, y = F.array_join("before", ""), F.array_join("after", "")
    action = F.when(y == "", "delete").when(x == "", "insert").otherwise("replace")
    size = F.least(F.greatest(F.size("before"), F.size("after")), F.lit(3)).cast("string")
    long = edits.select(*keys, action.alias("action"), size.alias("size"), (F.lower(x) == F.lower(y)).cast("string").alias("case_only")).unpivot(keys, ["action", "size", "case_only"], "feature", "value")
    return long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def grammar_examples(sentences: DataFrame, candidates: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """One wrong form a sentence: of the candidate places (keys, word_no, word, wrong) the first by a hash, and ``half`` 1 or 2 of
    the sentences in hash order."""
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("word_no").cast("string")))
    place = candidates.where("wrong is not null").groupBy(*keys).agg(F.min_by(F.struct("word_no", "word", "wrong"), order).alias("p"))
    half = F.when(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.lit("half"), *[F.col(k).cast("string") for k in keys])), F.lit(1)) < "8", 1).otherwise(2)
    return sentences.join(place, keys).select(*sentences.columns, "p.word_no", "p.word", "p.wrong", half.alias("half"))
