"""An index of three-letter sequences over text columns of a stored table, to open only files that can hold a match.

For every data file and column the index has the hashes of the sequences of three characters that occur, lower-cased. A search
word, the fixed parts of a LIKE pattern or of a regular expression are such sequences too, so files that lack one of
them are not read; what is read is still tested as if there were no index. Data files never change, so entries stay right
for good: new files are added, and entries of replaced files match nothing that is referred to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.small_files import stored_files
from tidewater.session import c
from tidewater.sources.store import PartitionStore

#: Hash parts of the index: a search reads those of its sequences.
PARTS = 64
_ENTRY = T.StructType([T.StructField("column", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType())])


def words(query: str) -> list[str]:
    """The fixed parts of a text_match query: its words in lower case, without * and ?."""
    return [x for x in (w.strip("*?") for w in query.lower().split()) if x]


def like_parts(pattern: str) -> list[str]:
    """The fixed parts of a LIKE pattern."""
    return [x.lower() for x in re.split(r"(?<!\\)[%_]", pattern.replace("\\\\", "%")) for x in [re.sub(r"\\(.)", r"\1", x)] if x]


def regex_parts(pattern: str) -> list[str]:
    """Texts that every match of a regular expression contains: runs of plain characters outside groups, classes and
    alternatives. An expression with | or an inline flag has none."""
    if "|" in pattern or "(?" in pattern:
        return []
    out, now, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            plain = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
            i += 1
        elif ch == "[":
            end = pattern.find("]", i + 2)
            i = len(pattern) if end < 0 else end
            plain = ""
        else:
            plain = ch if ch not in "()^$.*+?{}" else ""
            depth += (ch == "(") - (ch == ")")
        after = pattern[i + 1] if i + 1 < len(pattern) else ""
        if plain and not depth and after not in ("*", "?", "{"):
            now += plain
        else:
            out.append(now)
            now = ""
        if ch == "{":
            i = pattern.find("}", i) if "}" in pattern[i:] else len(pattern)
        i += 1
    return [x.lower() for x in [*out, now] if x]


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


@dataclass(frozen=True)
class _File:
    generation: str
    folder: str
    name: str


class TextIndex:
    def __init__(self, store: PartitionStore, columns: list[str]):
        self.store, self.columns = store, columns
        self.entries = PartitionStore(store.spark, f"{store.root}/_text", _ENTRY, ["part"])

    def _done(self) -> set[str]:
        """Generations that are indexed."""
        return {r["operation"].partition(" ")[2] for r in self.entries.history().select("operation").collect()}

    def update(self) -> int:
        """Index the files of generations that are not indexed yet; returns how many generations."""
        now = self.store.state()
        done = self._done()
        todo = {r.partition("/")[0] for refs in now.refs.values() for r in refs} - done
        for g in sorted(todo):
            refs = {f: [r for r in rs if r.partition("/")[0] == g] for f, rs in now.refs.items()}
            rows = self.store.scan(self.store.paths({f: r for f, r in refs.items() if r}, now.written))
            self.entries.replace(self._of(rows).hint("rebalance", F.col("part")).sortWithinPartitions("part", "column", "gram"), append=True, operation=f"index {g}")
        return len(todo)

    def _of(self, rows: DataFrame) -> DataFrame:
        """Distinct (column, gram, file): one pass over each text, reduced before anything shuffles."""
        name = F.regexp_extract("_metadata.file_path", "gen=(.*)$", 1).alias("file")
        kinds = dict(rows.dtypes)
        text = lambda x: F.lower(F.to_json(c(x)) if kinds[x] == "variant" else c(x).cast("string"))
        legs = F.array(*[F.struct(F.lit(x).alias("column"), F.regexp_extract_all(text(x), F.lit("(?s)(?=(.{3}))"), 1).alias("grams")) for x in self.columns])
        found = rows.select(name, F.explode(legs).alias("x")).select("file", "x.column", F.explode(F.array_distinct("x.grams")).alias("g"))
        hashed = found.select("column", F.xxhash64("g").alias("gram"), "file").distinct()
        return hashed.withColumn("part", F.pmod("gram", F.lit(PARTS)).cast("int"))

    def candidates(self, column: str, parts: list[str]) -> set[str] | None:
        """Files that can hold all of the fixed parts; None where these are too short to tell."""
        grams = sorted(set().union(*map(_grams, parts)))
        if not grams:
            return None
        wanted = self.store.spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("gram")).collect()
        hashes = {r["gram"] for r in wanted}
        held = self.entries.read({f"part={h % PARTS}" for h in hashes}).where((F.col("column") == column) & F.col("gram").isin(list(hashes)))
        return {r["file"] for r in held.groupBy("file").count().where(F.col("count") == len(hashes)).select("file").collect()}

    def rows(self, column: str, parts: list[str], test: Column) -> DataFrame:
        """Rows of the table that pass `test`, read from the candidates and from files that are not indexed yet."""
        now = self.store.state()
        found = self.candidates(column, parts)
        if found is None:
            return self.store.read().where(test)
        done = self._done()
        fresh = {f: [r for r in rs if r.partition("/")[0] not in done] for f, rs in now.refs.items()}
        indexed = {f: [r for r in rs if r.partition("/")[0] in done] for f, rs in now.refs.items()}
        live = {f"{x.generation}/{x.folder}/{x.name}" for x in self._listed(found, indexed)}
        paths = self.store.paths({f: r for f, r in fresh.items() if r}, {}) + [f"{self.store.root}/data/main/gen={x}" for x in sorted(live)]
        return self.store.scan(paths).where(test)

    def _listed(self, found: set[str], refs: dict[str, list[str]]) -> list[_File]:
        """The found files that the table refers to."""
        by = {f: set(r) for f, r in refs.items()}
        out = []
        for x in found:
            generation, _, rest = x.partition("/")
            folder, _, name = rest.rpartition("/")
            if by.get(folder, set()) & {generation, f"{generation}/{name}"}:
                out.append(_File(generation, folder, name))
        return out

    def match(self, column: str, query: str) -> DataFrame:
        """Rows for which text_match(column, query) holds."""
        low = F.lower(c(column).cast("string"))
        test = F.lit(True)
        for w in words(query):
            test = test & F.contains(low, F.lit(w))
        return self.rows(column, words(query), F.coalesce(test & low.isNotNull(), F.lit(False)))

    def like(self, column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
        return self.rows(column, like_parts(pattern), c(column).ilike(pattern) if ignore_case else c(column).like(pattern))

    def regex(self, column: str, pattern: str) -> DataFrame:
        return self.rows(column, regex_parts(pattern), c(column).rlike(pattern))

    def share_read(self, column: str, parts: list[str]) -> float:
        """The share of the table's bytes in files that a search opens."""
        found, files = self.candidates(column, parts), stored_files(self.store, self.store.state())
        if found is None:
            return 1.0
        here = F.concat_ws("/", "generation", "folder", "name").isin(list(found))
        a, b = files.agg(F.sum(F.when(here, F.col("size_bytes"))), F.sum("size_bytes")).first()
        return (a or 0) / b if b else 0.0
