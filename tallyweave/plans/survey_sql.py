"""SQL text of the enriched survey for the comparison engine, written as plain CASE maps
(independently of the recode parser) on top of the derived survey table."""

from __future__ import annotations

from tallyweave.plans.codebook import FEATURES, ISSUES
from tallyweave.sources.demo_survey import survey_sql


def _map(column: str, ones: str, zeros: str, unknown: str = "") -> str:
    null = f"WHEN {column} IN ({unknown}) THEN NULL " if unknown else ""
    return f"CASE WHEN {column} IN ({ones}) THEN 1 WHEN {column} IN ({zeros}) THEN 0 {null}ELSE {column} END"


MAPS = {
    "ervarengezondheid_dich": _map("KLGGA207", "3", "1,2", "9"),
    "regie_dich": _map("GGRLS203", "0", "1", "9"),
    "eenzaamheid_dich": _map("GGEES209", "1", "0,8", "9"),
    "inkomenzeerlaag_dich": _map("KwintielInk", "1", "2,3,4,5", "9"),
    "inkomenlaag_dich": _map("KwintielInk", "1,2", "3,4,5", "9"),
    "leeftijdcat6": "CASE WHEN Lftklassen = 1 THEN 1 WHEN Lftklassen BETWEEN 2 AND 4 THEN 2 "
    "WHEN Lftklassen BETWEEN 5 AND 7 THEN 3 WHEN Lftklassen IN (8,9) THEN 4 WHEN Lftklassen IN (10,11) THEN 5 "
    "WHEN Lftklassen BETWEEN 12 AND 14 THEN 6 WHEN Lftklassen = 99 THEN NULL ELSE Lftklassen END",
    "leeftijd70eo": "CASE WHEN Lftklassen IN (11,12,13,14) THEN 1 WHEN Lftklassen = 99 THEN NULL ELSE 0 END",
    "opl_lm": _map("Opleiding_samind", "1,2", "3,4", "9"),
    "ziek_lt": _map("CALGB260", "1", "2", "9"),
    "depri_hg": _map("GGADA202", "1", "0", "9"),
    "MMIKB201_dich": _map("MMIKB201", "4", "1,2,3"),
    **{f"{c}_dich": _map(c, "3", "1,2") for c in ("GGEEB201", "GGEEB204", "GGEEB207", "GGEEB208", "GGEEB211")},
    **{f"{c}_dich": _map(c, "1", "2,3") for c in ("GGEEB203", "GGEEB210")},
    **{f"{c}_dich": _map(c, "1", "2,3,4,5") for c in ("GGRLB201", "GGRLB202", "GGRLB204", "GGRLB206")},
    **{f"{c}_dich": _map(c, "1,2", "3,4,5") for c in ("GGADB201", "GGADB202", "GGADB204", "GGADB207", "GGADB210")},
    **{f"{c}_dich": _map(c, "1", "0", "9") for c in ("MCMZOS304", "CALGA260", "CALGA261", "LGBPS209")},
}

RULES = {
    "angstdepressie_dich": "CASE WHEN GGADS201 = 9 THEN NULL WHEN GGADS201 > 22 THEN 1 ELSE 0 END",
    "werkopleiding": "CASE WHEN MMWSA205 = 9 AND MMWSA211 = 9 THEN NULL WHEN MMWSA205 = 1 OR MMWSA211 = 1 THEN 1 ELSE 0 END",
    "vrijwilligerswerk": "CASE WHEN MMVWB201 = 9 THEN NULL WHEN MMVWB201 = 1 THEN 1 ELSE 0 END",
    "mantelzorg": "CASE WHEN MCMZGS203 = 9 THEN NULL WHEN MCMZGS203 IN (0,1) THEN MCMZGS203 END",
    "vriendenkring": "CASE WHEN GGEEB206 = 9 THEN NULL WHEN GGEEB206 IN (2,3) THEN 1 ELSE 0 END",
    "goedevriend": "CASE WHEN GGEEB202 = 9 THEN NULL WHEN GGEEB202 IN (2,3) THEN 1 ELSE 0 END",
    "mensenomheen": "CASE WHEN GGEEB209 = 9 THEN NULL WHEN GGEEB209 IN (2,3) THEN 1 ELSE 0 END",
}

FLIPS = ["werkopleiding", "vrijwilligerswerk", "mantelzorg", "vriendenkring", "goedevriend", "mensenomheen"]


def _listed(expressions: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in expressions.items())


_SCORE = " + ".join(f"coalesce({c}, 0)" for c in ISSUES)

SURVEY = f"survey AS MATERIALIZED ({survey_sql()})"
ENRICHED = (
    f"{SURVEY}, recoded AS (SELECT *, {_listed(MAPS)}, {_listed(RULES)} FROM survey), "
    f"enriched AS (SELECT *, {', '.join(f'CAST(1 - {c} AS INT) AS {c}_dich' for c in FLIPS)} FROM recoded)"
)
SCORED = f"{ENRICHED}, scored AS MATERIALIZED (SELECT *, CAST({_SCORE} AS INT) AS score_zw FROM enriched)"
_INCLUDED = "(GGEES203 > 8 OR GGRLS202 < 23 OR GGADS201 > 20 OR KLGGA207 = 3 OR score_zw > 4)"
INCLUDED = f"{SCORED}, included AS MATERIALIZED (SELECT * FROM scored WHERE {_INCLUDED})"
# a planted cluster label for the included group, null for everybody else
LABELLED = (
    f"{SCORED}, labelled AS MATERIALIZED (SELECT *, CASE WHEN {_INCLUDED} THEN CAST(1 + volgnummer % 9 AS INT) END AS cl_pam "
    "FROM scored)"
)
FEATURE_LIST = ", ".join(FEATURES)
