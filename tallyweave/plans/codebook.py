"""Column lists and recode rules of the public-health survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallyweave.functions.recode import assign_rules, flip, recode
from tallyweave.session import tuned

KEY = "volgnummer"
WEIGHT = "ewGGD"

# The recode maps of the survey, target column -> (source column, map).
RECODES = {
    "ervarengezondheid_dich": ("KLGGA207", "3=1; 1=0; 2=0; 9=NA"),
    "regie_dich": ("GGRLS203", "0=1; 1=0; 9=NA"),
    "eenzaamheid_dich": ("GGEES209", "1=1; 0=0; 8=0; 9=NA"),
    "inkomenzeerlaag_dich": ("KwintielInk", "1=1; 2=0; 3=0; 4=0; 5=0; 9=NA"),
    "inkomenlaag_dich": ("KwintielInk", "1=1; 2=1; 3=0; 4=0; 5=0; 9=NA"),
    "leeftijdcat6": ("Lftklassen", "1=1; 2:4=2; 5:7=3; 8:9=4; 10:11=5; 12:14=6; 99=NA"),
    "leeftijd70eo": ("Lftklassen", "11=1; 12=1; 13=1; 14=1; 99=NA; else=0"),
    "opl_lm": ("Opleiding_samind", "1=1; 2=1; 3=0; 4=0; 9=NA"),
    "ziek_lt": ("CALGB260", "1=1; 2=0; 9=NA"),
    "depri_hg": ("GGADA202", "0=0; 1=1; 9=NA"),
    "MMIKB201_dich": ("MMIKB201", "4=1; 3=0; 2=0; 1=0"),
    "GGEEB201_dich": ("GGEEB201", "3=1; 2=0; 1=0"),
    "GGEEB203_dich": ("GGEEB203", "1=1; 2=0; 3=0"),
    "GGEEB204_dich": ("GGEEB204", "3=1; 2=0; 1=0"),
    "GGEEB207_dich": ("GGEEB207", "3=1; 2=0; 1=0"),
    "GGEEB208_dich": ("GGEEB208", "3=1; 2=0; 1=0"),
    "GGEEB210_dich": ("GGEEB210", "1=1; 2=0; 3=0"),
    "GGEEB211_dich": ("GGEEB211", "3=1; 2=0; 1=0"),
    "GGRLB201_dich": ("GGRLB201", "1=1; 2=0; 3=0; 4=0; 5=0"),
    "GGRLB202_dich": ("GGRLB202", "1=1; 2=0; 3=0; 4=0; 5=0"),
    "GGRLB204_dich": ("GGRLB204", "1=1; 2=0; 3=0; 4=0; 5=0"),
    "GGRLB206_dich": ("GGRLB206", "1=1; 2=0; 3=0; 4=0; 5=0"),
    "GGADB201_dich": ("GGADB201", "1=1; 2=1; 3=0; 4=0; 5=0"),
    "GGADB202_dich": ("GGADB202", "1=1; 2=1; 3=0; 4=0; 5=0"),
    "GGADB204_dich": ("GGADB204", "1=1; 2=1; 3=0; 4=0; 5=0"),
    "GGADB207_dich": ("GGADB207", "1=1; 2=1; 3=0; 4=0; 5=0"),
    "GGADB210_dich": ("GGADB210", "1=1; 2=1; 3=0; 4=0; 5=0"),
    "MCMZOS304_dich": ("MCMZOS304", "0=0; 1=1; 9=NA"),
    # raw 0/1 items enter the feature set through a recode, so that an unknown code 9
    # cannot reach the issue count
    "CALGA260_dich": ("CALGA260", "0=0; 1=1; 9=NA"),
    "CALGA261_dich": ("CALGA261", "0=0; 1=1; 9=NA"),
    "LGBPS209_dich": ("LGBPS209", "0=0; 1=1; 9=NA"),
}

# Social columns whose 0/1 is flipped into a "lacking" feature.
FLIPPED = ["werkopleiding", "vrijwilligerswerk", "mantelzorg", "vriendenkring", "goedevriend", "mensenomheen"]

# The four outcome scales and the 22 features, in their order.
OUTCOMES = ["GGEES203", "GGRLS202", "GGADS201", "KLGGA207"]
DAILY_ACTIVITY = ["werkopleiding_dich", "vrijwilligerswerk_dich", "mantelzorg_dich"]
ISSUES = [
    "GGEEB201_dich", "GGEEB203_dich", "GGEEB204_dich", "GGEEB207_dich", "GGEEB208_dich",
    "CALGA260_dich", "CALGA261_dich", "LGBPS209_dich", "MMIKB201_dich",
    "GGRLB201_dich", "GGRLB202_dich", "GGRLB204_dich", "GGADB207_dich", "GGADB210_dich",
    "GGADB201_dich", "GGADB202_dich", "GGADB204_dich", "GGRLB206_dich", "MCMZOS304_dich",
]
FEATURES = DAILY_ACTIVITY + ISSUES

# Questions of the weighted crosstabs.
CROSSTAB_QUESTIONS = [
    "GGEES208", "GGADA202", "GGRLS203", "KLGGA207", "CALGA260", "CALGA261", "LGBPS209", "LGBPS205",
    "MMIKB201", "GGADB201", "MCMZOS304", "MCMZGS203",
    "KwintielInk", "MMWSA207", "Opleiding_samind", "MMWSA206", "MMWSA210", "MMVWB201", "AGHHS201",
]

# Situational variables of the per-cluster components.
SITUATION = [
    "leeftijd70eo", "ervarengezondheid_dich", "inkomenlaag_dich", "werkopleiding_dich", "vrijwilligerswerk_dich",
    "opl_lm", "ziek_lt", "mantelzorg_dich", "MCMZOS304_dich", "vriendenkring_dich",
]

# Raw answers the classifier is trained on.
TRAINING = [
    "GGEES203", "GGRLS202", "GGADS201", "KLGGA207",
    "MMIKB201", "CALGA260", "CALGA261", "LGBPS209", "AGGWS205", "GGEEB201", "GGEEB203", "GGEEB204", "GGEEB207",
    "GGEEB208", "GGRLB201", "GGRLB202", "GGRLB204", "GGRLB206", "GGADB201", "GGADB202", "GGADB204",
    "GGADB207", "GGADB210", "GGEEB210", "GGEEB211", "MCMZOS304",
]


def ordered_rules() -> dict[str, Column]:
    """Columns built by rules in which a later one overwrites an earlier one."""

    def yes_no(source: str) -> Column:
        return assign_rules([(f"{source} = 1", 1), (f"{source} = 9", None)], default=0)

    def lacking_friends(source: str) -> Column:
        return assign_rules([(f"{source} = 2 OR {source} = 3", 1), (f"{source} = 9", None)], default=0)

    return {
        "angstdepressie_dich": assign_rules([("GGADS201 > 22", 1), ("GGADS201 = 9", None)], default=0),
        "werkopleiding": assign_rules(
            [("MMWSA205 = 1 OR MMWSA211 = 1", 1), ("MMWSA205 = 9 AND MMWSA211 = 9", None)], default=0
        ),
        "vrijwilligerswerk": yes_no("MMVWB201"),
        "mantelzorg": assign_rules([("MCMZGS203 = 0", 0), ("MCMZGS203 = 1", 1), ("MCMZGS203 = 9", None)]),
        "vriendenkring": lacking_friends("GGEEB206"),
        "goedevriend": lacking_friends("GGEEB202"),
        "mensenomheen": lacking_friends("GGEEB209"),
    }


def enrich(survey: DataFrame) -> DataFrame:
    """Every recoded column next to the raw answers; two projections, no shuffle."""
    tuned(survey.sparkSession)
    base = survey.withColumns(
        {target: recode(source, spec) for target, (source, spec) in RECODES.items()} | ordered_rules()
    )
    return base.withColumns({f"{name}_dich": flip(name) for name in FLIPPED})
