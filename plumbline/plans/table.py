"""The table under lint, and the passes over it that checks share."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    Field,
    fences,
    is_filled,
    is_number,
    is_numeric_text,
    is_string,
    is_value,
    long_form,
    outside,
    positional,
)
from .brackets import Brackets
from .counters import COUNTERS_PER_PASS, profile
from .duplicates import duplicate_groups
from .quantiles import approximate_quartiles
from .samples import smallest
from .sharing import shared
from .values import Heavy, heavy, value_groups

# Which counters a check reads from the profile.
NEEDS = {
    "empty_columns": "nulls",
    "numeric_text": "text",
    "negative_values": "negative",
}


# The sample pass carries every column it formats beside each of its values, so
# its work grows with the square of this.
SAMPLED_PER_PASS = 40


class Table:
    """Plans for one run of one set of checks; building them runs no job.

    ``options`` maps every check of the run to its settings. Checks that need
    the same pass get the same frame, and Spark runs it once.
    """

    def __init__(
        self,
        df: DataFrame,
        options: dict[str, dict],
        samples: bool = True,
        sample_size: int = 5,
    ):
        self.spark = df.sparkSession
        self.schema = df.schema
        self.rows, self.fields = positional(df)
        self.options = options
        self.samples = samples
        self.sample_size = sample_size
        self._value_groups: dict[tuple, DataFrame] = {}

    @property
    def name(self) -> Column:
        """The name of column ``idx``; null for -1, the table as a whole."""
        names = F.lit(json.dumps([f.name for f in self.fields]))
        return F.get(F.from_json(names, "array<string>"), F.col("idx"))

    # -- counters ---------------------------------------------------------

    @cached_property
    def _profile(self) -> tuple[DataFrame, Column]:
        wanted = {NEEDS[c] for c in self.options if c in NEEDS}
        if self.options.get("iqr_outliers", {}).get("method") == "exact":
            wanted.add("ends")
        return profile(self.rows, self.fields, frozenset(wanted), self._heavy)

    @property
    def _heavy(self) -> dict[int, Heavy]:
        """Summaries of frequent values, of columns that are checked for them."""
        check = "category_dominance"
        if check not in self.options:
            return {}
        threshold = float(self.options[check]["threshold"])
        variants = self._spelt_along
        try:
            fields = self.text_fields(check)
        except ValueError:  # the check itself will tell
            return {}
        found = {f.idx: heavy(f.text, threshold, variants) for f in fields}
        return {idx: summary for idx, summary in found.items() if summary}

    @property
    def _spelt_along(self) -> bool:
        """Whether frequent values and spellings are found in the same pass."""
        both = {"category_dominance", "case_variants"} <= set(self.options)
        return both and self._same_columns("category_dominance", "case_variants")

    @property
    def profile(self) -> DataFrame:
        return self._profile[0]

    @property
    def total(self) -> Column:
        return self._profile[1]

    # -- values of text columns -------------------------------------------

    def text_fields(self, check: str) -> list[Field]:
        chosen = self.options[check].get("columns")
        names = None if chosen is None else set(chosen)
        kind = is_value if check == "category_dominance" else is_string
        fit = [f for f in self.fields if kind(f)]
        unfit = (names or set()) - {f.name for f in fit}
        if unfit:
            raise ValueError(f"no column of text: {', '.join(sorted(unfit))}")
        return [f for f in fit if names is None or f.name in names]

    def value_groups(self, check: str) -> DataFrame:
        """Counted values for dominance or spellings, in one pass for both."""
        fields = self.text_fields(check)
        partners = {check}
        if self._spelt_along:
            partners = {"category_dominance", "case_variants"}
        if "category_dominance" in partners:
            fields = self.text_fields("category_dominance")
        key = (frozenset(partners), tuple(f.idx for f in fields))
        if key not in self._value_groups:
            threshold = keys = None
            if "category_dominance" in partners:
                threshold = float(self.options["category_dominance"]["threshold"])
                if self._heavy:
                    keys = self.profile.selectExpr("idx", "explode(keys) as key")
            self._value_groups[key] = value_groups(
                self.texts(fields),
                len(fields),
                self.total,
                threshold,
                "case_variants" in partners,
                keys,
            )
        return self._value_groups[key]

    def _same_columns(self, check: str, other: str) -> bool:
        ours, theirs = self.options[check], self.options[other]
        return ours.get("columns") == theirs.get("columns")

    def texts(self, fields: Iterable[Field]) -> DataFrame:
        return long_form(self.rows, fields, lambda f: f.text, "value")

    # -- quartiles --------------------------------------------------------

    @property
    def number_fields(self) -> list[Field]:
        return [f for f in self.fields if is_number(f)]

    @cached_property
    def outliers(self) -> DataFrame:
        """``(idx, q1, q3, outliers)`` of columns with a finite, positive spread."""
        options = self.options["iqr_outliers"]
        if options["method"] == "exact":
            return Brackets(self, self.number_fields, options["multiplier"]).outliers()
        return self._outliers_of(
            approximate_quartiles(self.numbers(self.number_fields)).where(
                "q3 - q1 > 0 and q3 - q1 < double('Infinity')"
            )
        )

    def _outliers_of(self, quartiles: DataFrame) -> DataFrame:
        """The fences are one cell, so that a wide aggregate counts every column."""
        lower, upper = fences(self.options["iqr_outliers"]["multiplier"])
        counted = []
        for start in range(0, len(self.number_fields), COUNTERS_PER_PASS):
            chunk = self.number_fields[start : start + COUNTERS_PER_PASS]
            ends = [
                f"max(case when idx = {f.idx} then {end} end) as {name}{f.idx}"
                for f in chunk
                for name, end in (("low", lower), ("high", upper))
            ]
            cell = quartiles.selectExpr(*ends).selectExpr("struct(*) as cell")
            wide = self.rows.select(
                *[f.col for f in chunk], cell.scalar().alias("fence")
            )
            aggregates = [
                f"count_if(({f.number}) < fence.low{f.idx} "
                f"or ({f.number}) > fence.high{f.idx}) as n{f.idx}"
                for f in chunk
            ]
            structs = ", ".join(
                f"struct({f.idx} as idx, n{f.idx} as outliers)" for f in chunk
            )
            counted.append(
                wide.selectExpr(*aggregates).selectExpr(f"inline(array({structs}))")
            )
        counts = reduce(DataFrame.unionByName, counted)
        return shared(counts.join(F.broadcast(quartiles), "idx"))

    def numbers(self, fields: list[Field], keep: Iterable[str] = ()) -> DataFrame:
        return long_form(self.rows, fields, lambda f: f.number, "x", keep)

    # -- duplicate rows ---------------------------------------------------

    @cached_property
    def duplicates(self) -> DataFrame:
        return duplicate_groups(self.rows, self.fields)

    # -- samples ----------------------------------------------------------

    @cached_property
    def number_samples(self) -> DataFrame | None:
        """One pass for the samples of both numeric checks.

        Only flagged columns pass the join, and if there are none Spark skips
        the scan.
        """
        if not self.number_fields:
            return None
        flagged = []
        if "negative_values" in self.options:
            flagged.append(
                self.profile.where("negative > 0").selectExpr(
                    "idx",
                    "'negative_values' as check",
                    "cast(null as double) as q1",
                    "cast(null as double) as q3",
                )
            )
        multiplier = 0.0
        if "iqr_outliers" in self.options:
            multiplier = self.options["iqr_outliers"]["multiplier"]
            flagged.append(
                self.outliers.where("outliers > 0").selectExpr(
                    "idx", "'iqr_outliers' as check", "q1", "q3"
                )
            )
        flags = F.broadcast(reduce(DataFrame.unionByName, flagged))
        far = outside("x", multiplier)
        offending = f"case when check = 'negative_values' then x < 0 else {far} end"
        found = []
        for start in range(0, len(self.number_fields), SAMPLED_PER_PASS):
            fields = self.number_fields[start : start + SAMPLED_PER_PASS]
            # Formatted from the column itself: a bigint keeps all its digits.
            cases = [f"when {f.idx} then cast({f.col} as string)" for f in fields]
            candidates = (
                self.numbers(fields, keep=[f.col for f in fields])
                .join(flags, "idx")
                .where(offending)
                .selectExpr(
                    "idx", "check", "x", f"case idx {' '.join(cases)} end as text"
                )
            )
            found.append(
                smallest(candidates, ["x", "text"], "text", self.sample_size)
            )
        return reduce(DataFrame.unionByName, found)

    def text_samples(self, check: str, flagged: DataFrame) -> DataFrame | None:
        """Values that are not numbers, of the flagged columns alone."""
        fields = [f for f in self.fields if is_string(f)]
        if not fields:
            return None
        odd = f"{is_filled('value')} and not {is_numeric_text('value')}"
        candidates = (
            self.texts(fields)
            .join(F.broadcast(flagged.select("idx")), "idx", "left_semi")
            .where(odd)
            .selectExpr(f"'{check}' as check", "idx", "value")
        )
        return smallest(candidates, ["value"], "value", self.sample_size)
