"""Languages by file name: patterns and suffixes in the order of registration, and what is registered twice."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions import paths


@dataclass(frozen=True)
class Language:
    name: str
    #: Patterns of whole names: * any text, ? any character, [ab] and [!ab] sets.
    patterns: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    #: (suffix, parser) of those files that another parser than the language's own takes.
    dialects: tuple[tuple[str, str], ...] = ()


def pattern(glob: str) -> str:
    """A pattern as a regular expression over a lower-cased name."""
    out = ""
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", glob.lower(), re.S):
        if part == "*":
            out += ".*"
        elif part == "?":
            out += "."
        elif len(part) > 2 and part[0] == "[":
            inside = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside.replace("^", "\\^", 1) if inside[0] == "^" else inside) + "]"
        else:
            out += re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", part)
    return out


@dataclass(frozen=True)
class Registry:
    languages: tuple[Language, ...]

    def _rule(self, language: Language) -> str:
        """All of a language's names as one automaton."""
        ends = [f".+{pattern(s.replace('[', '[[]'))}" for s in language.suffixes]
        return rf"(?s)\A(?:{'|'.join([*map(pattern, language.patterns), *ends])})\z"

    def language(self, path: Column) -> Column:
        """The first registered language that takes the last part of a path, in any case; null for none."""
        name = F.lower(F.element_at(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), -1))
        out = F.lit(None).cast("string")
        for language in reversed(self.languages):
            if language.patterns or language.suffixes:
                out = F.when(F.rlike(name, F.lit(self._rule(language))), F.lit(language.name)).otherwise(out)
        return out

    def parser_name(self, path: Column) -> Column:
        """The parser of the language that takes the path."""
        out = self.language(path)
        for language in self.languages:
            for suffix, parser in language.dialects:
                out = F.when((self.language(path) == language.name) & F.endswith(F.lower(F.trim(path)), F.lit(suffix)), parser).otherwise(out)
        return out

    def required(self, path: Column) -> Column:
        """language(), which raises where there is none."""
        return F.coalesce(self.language(path), F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(path, F.lit("")))).cast("string"))

    def names(self) -> tuple[str, ...]:
        return tuple(x.name for x in self.languages)

    def rules(self, spark: SparkSession) -> DataFrame:
        """kind, value, language: every pattern and suffix in the order in which they are tried."""
        rows = [(kind, v, x.name, i) for i, x in enumerate(self.languages) for kind, values in (("pattern", x.patterns), ("suffix", x.suffixes)) for v in values]
        return spark.createDataFrame(rows, "kind string, value string, language string, place int")

    def violations(self, spark: SparkSession) -> DataFrame:
        """kind, value, languages: names, patterns and suffixes that are registered more than once, and names that are empty."""
        rows = [("name", x.name.lower(), i, x.name) for i, x in enumerate(self.languages)]
        rows += [(kind, v.lower(), i, x.name) for i, x in enumerate(self.languages) for kind, values in (("pattern", x.patterns), ("suffix", x.suffixes)) for v in values]
        table = spark.createDataFrame(rows, "kind string, value string, at int, name string")
        found = table.groupBy("kind", "value").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("languages"))
        return found.where((F.col("n") > 1) | (F.trim("value") == "")).select("kind", "value", "languages")


#: What this package parses.
DEFAULT = Registry(tuple(Language(n, suffixes=s, dialects=((".tsx", "tsx"),) if ".tsx" in s else ()) for n, s in paths.SUFFIXES.items()))
