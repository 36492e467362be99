"""Rules over a parse: a deterministic shift-reduce parser over part-of-speech tags, and findings that need its arcs.

The parser is a stack machine with a grammar that is a table: words and marks are shifted one by one, and whenever the
top of the stack is the left side of a rule (and the next symbol does not forbid it), it becomes the rule's result and
leaves an arc. So a sentence costs its length, and the same tags give the same arcs everywhere. The parser is one Arrow
function over tag strings; tags come from a lexicon by joins, and agreement is checked on all parses of the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import morphology, patterns

ARC = "array<struct<dependent:int,head:int,relation:string>>"
#: Noun phrases that cannot be in the nominative.
OBLIQUE = "n"


@dataclass(frozen=True)
class Rule:
    """``left``: symbols on top of the stack; the one at ``head`` stays as ``result``, the one at ``dependent`` hangs on it by
    ``relation``. ``unless``: symbols that may follow and would belong to what is on the stack; ``behind``: symbols that may
    stand before it on the stack and make it something else."""

    left: str
    result: str
    head: int
    dependent: int
    relation: str
    unless: str = ""
    behind: str = ""


def _phrases() -> list[Rule]:
    out = []
    for noun in "N" + OBLIQUE:
        out += [Rule(f"{m}{noun}", noun, 1, 0, "nummod" if m == "U" else "amod", behind="Nn," if m == "F" and noun == OBLIQUE else "") for m in "AFU"]
        out += [Rule(f"{noun}{OBLIQUE}", noun, 0, 1, "nmod"), Rule(f"{noun}P", noun, 0, 1, "nmod"), Rule(f"R{noun}", "P", 0, 1, "case", f"{OBLIQUE}C")]
        out += [Rule(f"{noun}C{noun}", noun, 0, 2, "conj", OBLIQUE), Rule(f"{noun},F,", noun, 0, 2, "acl"), Rule(f"{noun}F", noun, 0, 1, "acl_bare", "RADn")]
    return out


#: Longer left sides first, so that a coordination is not taken apart.
GRAMMAR = sorted(
    [
        *_phrases(),
        Rule("RO", "P", 0, 1, "case"), Rule("DA", "A", 1, 0, "advmod"), Rule("DF", "F", 1, 0, "advmod"), Rule("DV", "V", 1, 0, "advmod"),
        Rule("ACA", "A", 0, 2, "conj"), Rule("FP", "F", 0, 1, "obl"), Rule("Fn", "F", 0, 1, "obj"),
        Rule("NV", "V", 1, 0, "nsubj"), Rule("OV", "V", 1, 0, "nsubj"), Rule("N,V", "V", 2, 0, "nsubj_comma"),
        Rule("VP", "V", 0, 1, "obl"), Rule("Vn", "V", 0, 1, "obj", "C"), Rule("VN", "V", 0, 1, "nsubj", "nRCFP,"), Rule("VO", "V", 0, 1, "nsubj"), Rule("VI", "V", 0, 1, "xcomp"),
    ],
    key=lambda r: (-len(r.left), r.left),
)


def arcs(tags: str, gaps: str, grammar: list[Rule] = GRAMMAR) -> list[tuple[int, int, str]]:
    """(dependent, head, relation) of words; ``gaps`` has one character behind each word: a comma, a blank, or | for other marks."""
    marked: list[tuple[str, int]] = []
    for i, t in enumerate(tags):
        marked.append(("V" if t in "SJ" else t, i))
        if i < len(gaps) and gaps[i] != " ":
            marked.append((gaps[i], -1))
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int, str]] = []
    by_last: dict[str, list[Rule]] = {}
    for rule in grammar:
        by_last.setdefault(rule.left[-1], []).append(rule)
    for k, symbol in enumerate(marked):
        stack.append(symbol)
        following = marked[k + 1][0] if k + 1 < len(marked) else ""
        while True:
            for rule in by_last.get(stack[-1][0], ()):
                n = len(rule.left)
                before = stack[-n - 1][0] if n < len(stack) else ""
                if n > len(stack) or following and following in rule.unless or before and before in rule.behind:
                    continue
                if all(s[0] == c for s, c in zip(stack[-n:], rule.left, strict=True)):
                    top = stack[-n:]
                    out.append((top[rule.dependent][1], top[rule.head][1], rule.relation))
                    stack[-n:] = [(rule.result, top[rule.head][1])]
                    break
            else:
                break
    return out


def parsed(tags: Column | str, gaps: Column | str) -> Column:
    """Arcs of tag strings (see :func:`arcs`); null tags have none."""
    kind = pa.list_(pa.struct([("dependent", pa.int32()), ("head", pa.int32()), ("relation", pa.string())]))

    def run(tag_column: pa.Array, gap_column: pa.Array) -> pa.Array:
        rows = [[{"dependent": d, "head": h, "relation": r} for d, h, r in arcs(t or "", g or "")] for t, g in zip(tag_column.to_pylist(), gap_column.to_pylist(), strict=True)]
        return pa.array(rows, kind)

    return F.arrow_udf(run, ARC)(tags, gaps)


def gap_marks(text: Column) -> Column:
    """One character for what stands behind each word: a blank, a comma, or | for anything else."""
    parts = F.split(text, T.WORD, -1)
    mark = lambda p: F.when(F.trim(p) == "", " ").when(F.trim(p) == ",", ",").otherwise("|")
    return F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), mark), "")


def units(sentences: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(keys, words, tags, gaps) of sentences; a noun without a nominative reading has the tag of an oblique one."""
    rows = sentences.select(*keys, F.posexplode(T.words(F.col(text))).alias("word_no", "word"))
    tagged = morphology.possible(morphology.coarse_pos(rows, lexicon), lexicon)
    oblique = (F.col("pos") == "NOUN") & (F.size("cases") > 0) & ~F.array_contains("cases", "nomn")
    one = F.struct("word_no", "word", F.when(oblique, OBLIQUE).otherwise(patterns.tag(F.col("pos"))).alias("t"))
    grouped = tagged.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("w"))
    marks = sentences.select(*keys, gap_marks(F.col(text)).alias("gaps"))
    return grouped.select(*keys, F.col("w.word").alias("words"), F.concat_ws("", "w.t").alias("tags")).join(marks, keys)


def dependencies(parsed_units: DataFrame, keys: list[str]) -> DataFrame:
    """One row an arc: (keys, dependent, head, relation, dependent_word, head_word) of units with ``words``, ``tags`` and ``gaps``."""
    rows = parsed_units.select(*keys, "words", F.explode(parsed("tags", "gaps")).alias("a"))
    return rows.select(*keys, "a.*", F.get("words", F.col("a.dependent")).alias("dependent_word"), F.get("words", F.col("a.head")).alias("head_word"))


def subject_verb(dependencies_: DataFrame, lexicon: DataFrame, keys: list[str], skipped: list[str] = ()) -> DataFrame:
    """Verbs that agree with their subject in none of both words' readings: (keys, word_no, word, subject_no, subject, level).

    The subject is read in the nominative only. Coordinated and counted subjects, words of ``skipped``, and words that do
    not decline are left alone; a singular verb needs the gender too where both have one, a pronoun the person."""
    pick = lambda names: F.get(F.filter("grammemes", lambda g: g.isin(names)), F.lit(0))
    reading = F.struct("pos", pick(["sing", "plur"]).alias("number"), pick(["masc", "femn", "neut"]).alias("gender"), pick(["1per", "2per", "3per"]).alias("person"))
    fixed = F.arrays_overlap("grammemes", F.array(F.lit("Fixd"), F.lit("Abbr")))
    named = lexicon.withColumn("r", reading)
    verbs = named.where("pos in ('VERB', 'PRTS', 'ADJS') and r.number is not null").groupBy(F.col("form").alias("_v")).agg(F.collect_set("r").alias("_vs"))
    nominative = F.array_contains("grammemes", "nomn") & F.col("pos").isin("NOUN", "NPRO") & F.col("r.number").isNotNull()
    subjects = named.where(nominative).groupBy(F.col("form").alias("_s")).agg(F.collect_set("r").alias("_ss"), F.max(fixed.cast("int")).alias("_fixed")).where("_fixed = 0")
    held = dependencies_.where("relation in ('conj', 'nummod')").select(*keys, F.col("head").alias("dependent")).distinct()
    found = dependencies_.where("relation in ('nsubj', 'nsubj_comma')").where(~F.lower("dependent_word").isin(list(skipped)) if skipped else F.lit(True))
    found = found.join(held, [*keys, "dependent"], "left_anti").join(verbs, F.lower("head_word") == F.col("_v")).join(subjects, F.lower("dependent_word") == F.col("_s"))
    gender = lambda s, v: (v["number"] != "sing") | v["gender"].isNull() | s["gender"].isNull() | (v["gender"] == s["gender"])
    person = lambda s, v: (s["pos"] != "NPRO") | s["person"].isNull() | v["person"].isNull() | (s["person"] == v["person"])
    agrees = F.exists("_ss", lambda s: F.exists("_vs", lambda v: (s["number"] == v["number"]) & gender(s, v) & person(s, v)))
    return found.where(~agrees).select(*keys, F.col("head").alias("word_no"), F.col("head_word").alias("word"), F.col("dependent").alias("subject_no"), F.col("dependent_word").alias("subject"), F.lit("check").alias("level"))


def participle_commas(dependencies_: DataFrame, keys: list[str]) -> DataFrame:
    """Words behind which a comma opens a participial phrase: the participle follows its noun, has words of its own, and all behind it."""
    own = dependencies_.groupBy(*keys, F.col("head").alias("dependent")).agg(F.min("dependent").alias("_first"))
    bare = dependencies_.where("relation = 'acl_bare' and dependent = head + 1").select(*keys, "dependent", "head")
    return bare.join(own, [*keys, "dependent"]).where("_first > dependent").select(*keys, F.col("head").alias("word_no"), F.lit("COMMA_PARTICIPLE").alias("rule"), F.lit("check").alias("level"))


def subject_commas(dependencies_: DataFrame, keys: list[str]) -> DataFrame:
    """Words behind which a single comma stands between the subject and its verb."""
    rows = dependencies_.where("relation = 'nsubj_comma'")
    return rows.select(*keys, (F.col("head") - 1).alias("word_no"), F.lit("NO_COMMA_SUBJ_PRED").alias("rule"), F.lit("check").alias("level"))


def subordinate_commas(text_units: DataFrame, keys: list[str], words: str, gaps: str, openers: list[str], relatives: list[str], prepositions: list[str], never_after: list[str]) -> DataFrame:
    """Words behind which a comma is missing before a conjunction (``openers``) or a relative pronoun, which may follow a preposition.

    None is missing behind a word of ``never_after`` or where another mark stands."""
    rows = text_units.select(*keys, F.transform(words, lambda w: F.lower(w)).alias("w"), F.col(gaps).alias("g")).where(F.size("w") > 1)
    at = F.sequence(F.lit(1), F.size("w") - 1)
    word = lambda i: F.get("w", i)
    opens = F.filter(at, lambda i: word(i).isin([*openers, *relatives]))
    begins = F.transform(opens, lambda i: F.when(word(i).isin(relatives) & word(i - 1).isin(prepositions), i - 1).otherwise(i))
    lacking = F.filter(begins, lambda k: (k > 0) & ~word(k - 1).isin(never_after) & (F.substr("g", k, F.lit(1)) == " "))
    return rows.select(*keys, F.explode(F.array_distinct(lacking)).alias("_k")).select(*keys, (F.col("_k") - 1).alias("word_no"), F.lit("COMMA_BEFORE_SUBORD").alias("rule"), F.lit("check").alias("level"))


def example_marks(text_units: DataFrame, keys: list[str], words: str, tags: str, gaps: str, first: str, second: str) -> DataFrame:
    """Two words that introduce examples (такие как, such as): a comma is missing before them behind a noun or adjective, and no
    colon follows. ``gaps`` has | for a colon."""
    rows = text_units.select(*keys, F.transform(words, lambda w: F.lower(w)).alias("w"), F.col(tags).alias("t"), F.col(gaps).alias("g")).where(F.size("w") > 1)
    pairs = F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: (F.get("w", i) == first) & (F.get("w", i + 1) == second))
    commas = F.filter(pairs, lambda i: (i > 0) & (F.substr("g", i, F.lit(1)) == " ") & F.substr("t", i, F.lit(1)).isin("N", OBLIQUE, "A"))
    colons = F.filter(pairs, lambda i: F.substr("g", i + 2, F.lit(1)) == "|")
    one = lambda at, rule: F.struct(at.alias("word_no"), F.lit(rule).alias("rule"), F.lit("check").alias("level"))
    found = F.concat(F.transform(commas, lambda i: one(i - 1, "COMMA_BEFORE_EXAMPLES")), F.transform(colons, lambda i: one(i + 1, "NO_COLON_AFTER_EXAMPLES")))
    return rows.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def breaks_grammar(edits: DataFrame, text_units: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Edits (keys, word_no, new) after which more violations (preposition and case, adjective and noun) touch the word than before.

    Both texts are checked by the same joins; only the words around an edit are built anew."""
    words = text_units.select(*keys, F.posexplode("words").alias("word_no", "word"))
    own = [*keys, "edit_no"]
    near = edits.select(*keys, F.col("word_no").alias("edit_no"), "new").distinct()
    around = words.join(near, keys).where("abs(word_no - edit_no) <= 1")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        found = [f(rows, lexicon, own).select(*own, "word_no") for f in (morphology.preposition_case, morphology.adjective_noun)]
        return found[0].union(found[1]).where("word_no in (edit_no, edit_no - 1)").groupBy(*own).agg(F.count(F.lit(1)).alias(name))

    before = counted(around.select(*own, "word_no", "word"), "_before")
    after = counted(around.select(*own, "word_no", F.when(F.col("word_no") == F.col("edit_no"), F.col("new")).otherwise(F.col("word")).alias("word")), "_after")
    worse = after.join(before, own, "left").where("_after > coalesce(_before, 0)")
    return worse.select(*keys, F.col("edit_no").alias("word_no"))
