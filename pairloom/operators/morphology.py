"""A morphological analyser from tables: words as prefix, stem and suffix whose categories go together (UDF07).

Its data are six tables, as analysers of this kind have them: the forms of prefixes, stems and suffixes with a category each, and the pairs of categories that may meet
(``prefix_stem``, ``stem_suffix``, ``prefix_suffix``). They are compiled into one automaton, which reads a word forward through prefixes and stems and backward through suffixes, and drops a
reading as soon as no category is left that may follow. It runs over distinct words, in Arrow batches, and gives every analysis.

The automaton travels with the tasks, so it is only built for up to ``limit`` letters of stems; beyond that stems stay a table: affixes alone cut each distinct word, and the
rests are joined with the stems, which Spark may spread as it likes. Both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import ARABIC, tokens

LIMIT = 1 << 22
ANALYSIS = "word string, prefix string, stem string, suffix string, prefix_category string, stem_category string, suffix_category string"


@dataclass
class Morphology:
    """Forms ``form, category`` of ``prefixes``, ``stems``, ``suffixes`` (an empty form stands for none) and pairs ``a, b`` of categories that go together."""

    prefixes: DataFrame
    stems: DataFrame
    suffixes: DataFrame
    prefix_stem: DataFrame
    stem_suffix: DataFrame
    prefix_suffix: DataFrame


class Automaton:
    """Tries of the three kinds of forms in one numbering of nodes, and for each category the set (bits) of categories that may come with it."""

    def __init__(self, forms: list[list[tuple[str, str]]], pairs: list[set[tuple[str, str]]]) -> None:
        self.next: list[dict[str, int]] = [{}, {}, {}]
        self.ends: dict[int, list[int]] = defaultdict(list)
        names: list[dict[str, int]] = [{}, {}, {}]
        for layer, rows in enumerate(forms):
            for form, category in rows:
                node = layer
                for x in reversed(form) if layer == 2 else form:
                    if x not in self.next[node]:
                        self.next[node][x] = len(self.next)
                        self.next.append({})
                    node = self.next[node][x]
                number = names[layer].setdefault(category, len(names[layer]))
                if number not in self.ends[node]:
                    self.ends[node].append(number)
        self.names = [list(x) for x in names]
        bits = lambda have, other, own: [sum(1 << k for k, y in enumerate(other) if (x, y) in own) for x in have]
        p, s, x = self.names
        self.stems_of, self.suffixes_of, self.far = bits(p, s, pairs[0]), bits(s, x, pairs[1]), bits(p, x, pairs[2])

    def analyses(self, word: str) -> list[tuple[str, str, str, str, str, str]]:
        """All readings, in the order of where prefix and stem end."""
        after: dict[int, list[int]] = {}
        node, at = 2, len(word)
        while True:
            if found := self.ends.get(node):
                after[at] = found
            if not at or (node := self.next[node].get(word[at - 1], -1)) < 0:
                break
            at -= 1
        out, node = [], 0
        if not after:
            return out
        for first in range(len(word) + 1):
            if found := self.ends.get(node):
                stem = 1
                wanted = 0
                for p in found:
                    wanted |= self.stems_of[p]
                for end in range(first, len(word) + 1):
                    for s in self.ends.get(stem, ()) if end in after and wanted else ():
                        for p in found if wanted >> s & 1 else ():
                            if self.stems_of[p] >> s & 1:
                                may = self.suffixes_of[s] & self.far[p]
                                out += [(word[:first], word[first:end], word[end:], self.names[0][p], self.names[1][s], self.names[2][x]) for x in after[end] if may >> x & 1]
                    if end == len(word) or (stem := self.next[stem].get(word[end], -1)) < 0:
                        break
            if first == len(word) or (node := self.next[node].get(word[first], -1)) < 0:
                break
        return out


def compiled(tables: Morphology) -> Automaton:
    forms = [[(r.form or "", r.category) for r in t.select("form", "category").distinct().collect()] for t in (tables.prefixes, tables.stems, tables.suffixes)]
    pairs = [{(r.a, r.b) for r in t.select("a", "b").distinct().collect()} for t in (tables.prefix_stem, tables.stem_suffix, tables.prefix_suffix)]
    return Automaton(forms, pairs)


def _run(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ANALYSIS.split(", ")]
        for batch in batches:
            rows = [(w, *a) for w in batch.column(0).to_pylist() if w is not None for a in automaton.analyses(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return run


def analyses(words: DataFrame, tables: Morphology, limit: int = LIMIT) -> DataFrame:
    """All analyses of each distinct ``word``: the three forms and their categories. Words without one give no row."""
    distinct = words.select("word").distinct()
    size = tables.stems.agg(F.coalesce(F.sum(F.length("form") + 1), F.lit(0))).head()[0]
    if size <= limit:
        return distinct.mapInArrow(_run(compiled(tables)), ANALYSIS)
    return _joined(distinct, tables)


def _joined(distinct: DataFrame, tables: Morphology) -> DataFrame:
    """The same with the stems as a table: every cut of a word whose ends are affixes that may come together, joined on the rest."""
    named = lambda t, x: t.select(F.coalesce("form", F.lit("")).alias(x), F.col("category").alias(f"{x}_category")).distinct()
    paired = lambda t, x, y: t.select(F.col("a").alias(f"{x}_category"), F.col("b").alias(f"{y}_category")).distinct()
    prefixes, stems, suffixes = named(tables.prefixes, "prefix"), named(tables.stems, "stem"), named(tables.suffixes, "suffix")
    longest = [t.agg(F.coalesce(F.max(F.length(c)), F.lit(0))).head()[0] for t, c in ((prefixes, "prefix"), (suffixes, "suffix"))]
    n = F.length("word")
    cuts = distinct.where("word IS NOT NULL").select("word", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(longest[0])))).alias("first"))
    cuts = cuts.select("word", "first", F.explode(F.sequence(F.greatest(F.col("first"), n - longest[1]), n)).alias("end"))
    part = lambda a, b: F.substring("word", F.lit(a) + 1 if isinstance(a, int) else a + 1, b - a)
    cuts = cuts.select("word", part(0, F.col("first")).alias("prefix"), part(F.col("first"), F.col("end")).alias("stem"), part(F.col("end"), n).alias("suffix"))
    found = cuts.join(prefixes, "prefix").join(suffixes, "suffix").join(paired(tables.prefix_suffix, "prefix", "suffix"), ["prefix_category", "suffix_category"]).join(stems, "stem")
    found = found.join(paired(tables.prefix_stem, "prefix", "stem"), ["prefix_category", "stem_category"]).join(paired(tables.stem_suffix, "stem", "suffix"), ["stem_category", "suffix_category"])
    return found.select(*[x.split()[0] for x in ANALYSIS.split(", ")])


def known_words(texts: DataFrame, columns: list[str], tables: Morphology, letters: str = ARABIC, limit: int = LIMIT) -> DataFrame:
    """``word``: the words of some text columns that have an analysis, as a lexicon for what asks for one."""
    words = [F.filter(tokens(F.col(c)), lambda x: x.rlike(letters)) for c in columns]
    return analyses(texts.select(F.explode(F.array_distinct(F.concat(*words))).alias("word")), tables, limit).select("word").distinct()
