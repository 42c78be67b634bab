"""The usage study as one composition of operators.

``UsageStudy`` wires the operator functions into the chain
dictionary -> discovery (T2) -> scan (T1) -> unknown terms (T3) -> ids (K8)
-> manual flags (K6) -> fragments (T7, T9) -> exclusion (T8) -> filtered view
(T11), and materialises the raw usage table once (K3) because every analysis
starts from it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exclude, scan, tables
from ..schema import TERMS
from ..sources.files import balance, explode_lines
from ..sources.sinks import materialise
from .fixtures import UsageInputs

INTERNAL_DEFAULTS = {"category": scan.INTERNAL_CATEGORY, "machine_specific": False,
                     "doc_url": "-", "header": "Internal GCC builtins", "documented": False}
UNKNOWN_DEFAULTS = {"category": scan.UNKNOWN_CATEGORY, "machine_specific": False,
                    "documented": False}


class UsageStudy:
    def __init__(self, inputs: UsageInputs, unknown_pattern: str = scan.UNKNOWN_PATTERN,
                 by_term: bool = True, materialize: bool = True):
        self.i = inputs
        self.unknown_pattern = unknown_pattern
        self.by_term = by_term
        self.materialize = materialize

    # ---- dictionary and scan
    @cached_property
    def lines(self) -> DataFrame:
        return exclude.line_flags(explode_lines(balance(self.i.files)))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name) if self.materialize else df

    @cached_property
    def documented_names(self) -> DataFrame:
        return self.i.term_defs.select("name")

    @cached_property
    def internal_names(self) -> DataFrame:
        """Pattern-matching identifiers of the definitive corpus that are
        not documented."""
        found = scan.discover_terms(explode_lines(self.i.reference_files), self.documented_names,
                                    self.unknown_pattern)
        return self._keep(found, "internal_names")

    @cached_property
    def unknown_names(self) -> DataFrame:
        """Pattern-matching identifiers of the studied files that are
        neither documented nor internal."""
        known = self.documented_names.unionByName(self.internal_names)
        return scan.discover_terms(self.lines, known, self.unknown_pattern)

    @cached_property
    def terms(self) -> DataFrame:
        """Full dictionary (K8): documented, then internal, then unknown terms,
        ids in (group, name) order from one distributed rank; materialised."""
        def with_defaults(names: DataFrame, defaults: dict) -> DataFrame:
            cols = [F.col("name")]
            for f in TERMS.fields:
                if f.name not in ("id", "name"):
                    cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
            return names.select(*cols)

        documented = self.i.term_defs.select(*[c for c in TERMS.fieldNames() if c != "id"])
        parts = [documented, with_defaults(self.internal_names, INTERNAL_DEFAULTS),
                 with_defaults(self.unknown_names, UNKNOWN_DEFAULTS)]
        return self._keep(tables.assign_ids(parts, TERMS), "terms")

    @cached_property
    def known_terms(self) -> DataFrame:
        """Documented + internal terms (the dictionary before T3)."""
        return self.terms.where(~F.col("category").eqNullSafe(scan.UNKNOWN_CATEGORY))

    @cached_property
    def marks(self) -> DataFrame:
        """Paths of the hand-flagged files, materialised: their size is known."""
        return self._keep(self.i.manual_marks.select("path").distinct(), "marks")

    @cached_property
    def flagged_lines(self) -> DataFrame:
        """``lines`` with ``excluded``: the file is flagged by hand (K6)."""
        files = tables.flag_where(balance(self.i.files).withColumn("excluded", F.lit(False)),
                                  self.marks, "path", "excluded")
        return exclude.line_flags(explode_lines(files))

    @cached_property
    def usages_raw(self) -> DataFrame:
        """T1 with the complete dictionary + manual flags (K6), materialised:
        (project_id, path, line_nr, term_id, excluded, line_key, vendored,
        marker, auto_category). The text of a line is not repeated per usage;
        ``line_key`` stands for it.
        """
        lines = self.flagged_lines.withColumn("line_key", exclude.line_key(F.col("line")))
        # T7 is evaluated here, where line and term are at hand: only lines
        # with a comment / quote marker are classified (rule in exclude.py)
        u = scan.scan_terms(lines, self.terms, None) \
            .select("project_id", "path", "line_nr", "term_id", "excluded", "line_key", "vendored", "marker",
                    F.when(F.col("marker") & ~F.col("vendored"),
                           exclude.fragment_category(F.col("line"), F.col("term")))
                    .alias("auto_category"))
        return self._keep(u, "usages_raw")

    # ---- exclusion
    @cached_property
    def fragments_auto(self) -> DataFrame:
        return self._keep(exclude.fragments_from_scan(self.usages_raw), "fragments_auto")

    @cached_property
    def fragments(self) -> DataFrame:
        f = exclude.sync_manual(self.usages_raw, self.fragments_auto)
        return materialise(f, "fragments") if self.materialize else f

    def with_lines(self, fragments: DataFrame) -> DataFrame:
        """Fragments with the text of their lines, from the scanned files again."""
        able = self.flagged_lines.where(F.col("marker") | F.col("excluded"))
        return exclude.with_lines(fragments, able)

    @cached_property
    def usages_marked(self) -> DataFrame:
        return exclude.mark_excluded(self.usages_raw, self.fragments, self.by_term)

    @cached_property
    def projects(self) -> DataFrame:
        return self._keep(exclude.project_filter(self.i.projects), "projects")

    @cached_property
    def studied_terms(self) -> DataFrame:
        return self._keep(exclude.term_filter(self.terms, self.i.excluded_terms), "studied_terms")

    @cached_property
    def usages(self) -> DataFrame:
        """Every analysis of the study starts here. The kept usages are
        materialised without the attributes of projects and terms, which are
        joined (by broadcast) when read."""
        kept = self._keep(exclude.kept_usages(self.usages_marked), "usages")
        return exclude.with_attributes(kept, self.projects, self.studied_terms)
