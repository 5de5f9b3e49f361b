"""Column roles of a season table.

Every operator in this package takes a :class:`SeasonSpec` instead of
hard-coded column names, so the same code scores basketball seasons read
from CSV and the customer / supplier seasons derived from the test tables.
"""

from __future__ import annotations

from dataclasses import dataclass

PLAIN = "plain"          # z = (x - avg) / stdev
WEIGHTED = "weighted"    # impact = (pct - avg(pct)) * attempts, then z of impact
NEGATED = "negated"      # z = -(x - avg) / stdev


@dataclass(frozen=True)
class Measure:
    """One scored measure. ``col`` is the raw column; ``weight`` the attempts
    column of a weighted pair."""

    name: str
    kind: str
    col: str
    weight: str | None = None


@dataclass(frozen=True)
class SeasonSpec:
    entity: str = "name"
    period: str = "year"
    club: str = "team"
    age: str = "age"
    games: str = "gp"
    total_club: str = "TOT"
    rank: str | None = None
    # raw measures summarised per period (pass 1)
    raw: tuple[str, ...] = ()
    # scored measures, in output order
    measures: tuple[Measure, ...] = ()
    # columns carried into the prior-season feature table besides the keys
    carry: tuple[str, ...] = ("team", "gp")
    z_prefix: str = "z"
    n_prefix: str = "n"
    z_total: str = "zTOT"
    n_total: str = "nTOT"

    def z(self, m: Measure | str) -> str:
        return self.z_prefix + (m if isinstance(m, str) else m.name)

    def n(self, m: Measure | str) -> str:
        return self.n_prefix + (m if isinstance(m, str) else m.name)

    @property
    def z_cols(self) -> list[str]:
        return [self.z(m) for m in self.measures]

    @property
    def n_cols(self) -> list[str]:
        return [self.n(m) for m in self.measures]

    @property
    def score_names(self) -> list[str]:
        """Composite first, then each z measure (prior-season table order)."""
        return [self.z_total, self.n_total] + self.z_cols


# Column layout and measure roles of the per-season CSV files
# the reference ingests (field order as in the files' header line).
CSV_FIELDS = (
    "Rk", "Player", "Pos", "Age", "Tm", "G", "GS", "MP",
    "FG", "FGA", "FG%", "3P", "3PA", "3P%", "2P", "2PA", "2P%", "eFG%",
    "FT", "FTA", "FT%", "ORB", "DRB", "TRB", "AST", "STL", "BLK", "TOV", "PF", "PTS",
)
# The 22 raw measures, renamed as in the reference's players table.
CSV_RAW = (
    "FG", "FGA", "FGP", "3P", "3PA", "3PP", "2P", "2PA", "2PP", "eFG",
    "FT", "FTA", "FTP", "ORB", "DRB", "TRB", "AST", "STL", "BLK", "TOV", "PF", "PTS",
)
# Scored measures in the reference's order FG, FT, 3P, TRB, AST,
# STL, BLK, TOV, PTS; FG and FT are weighted by attempts, TOV is negated.
BASKETBALL = SeasonSpec(
    entity="name", period="year", club="team", age="age", games="gp", rank="Rk",
    raw=CSV_RAW,
    measures=(
        Measure("FG", WEIGHTED, "FGP", "FGA"),
        Measure("FT", WEIGHTED, "FTP", "FTA"),
        Measure("3P", PLAIN, "3P"),
        Measure("TRB", PLAIN, "TRB"),
        Measure("AST", PLAIN, "AST"),
        Measure("STL", PLAIN, "STL"),
        Measure("BLK", PLAIN, "BLK"),
        Measure("TOV", NEGATED, "TOV"),
        Measure("PTS", PLAIN, "PTS"),
    ),
    carry=("team", "gp", "gs", "mp"),
)

_TABLE_RAW = ("pct1", "att1", "pct2", "att2", "m1", "m2", "m3", "m4", "m5")


def _table_spec(plain: tuple[str, ...]) -> SeasonSpec:
    return SeasonSpec(
        raw=_TABLE_RAW + tuple(c for c in plain if c not in _TABLE_RAW) + ("neg1",),
        measures=(
            Measure("w1", WEIGHTED, "pct1", "att1"),
            Measure("w2", WEIGHTED, "pct2", "att2"),
            *(Measure(c, PLAIN, c) for c in plain),
            Measure("neg1", NEGATED, "neg1"),
        ),
    )


# Customer seasons: entity o_custkey, period order year, club order priority.
CUSTOMER = _table_spec(("m1", "m2", "m3", "m4", "m5", "m6"))
# Supplier seasons: entity l_suppkey, period ship year, club return flag.
SUPPLIER = _table_spec(("m1", "m2", "m3", "m4", "m5"))
