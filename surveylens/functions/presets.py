"""Survey preset: code maps, item lists, labels, bands and groupings.

Everything in this module is data. The operators take these values as
parameters, so the same code runs on other tables with other codes.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the published questionnaire coding and the
# labels used in the published tables, so they are stated here verbatim.
# ---------------------------------------------------------------------------

NO_RESPONSE = "No response"

GENDER_MAP = {1: "Male", 2: "Female", 3: "Other", 0: "No response"}
EDUCATION_MAP = {
    1: "Less than high school",
    2: "High school",
    3: "University degree",
    4: "Graduate degree",
    0: "No response",
}
URBAN_MAP = {1: "Rural", 2: "Suburban", 3: "Urban", 0: "No response"}
RELIGION_MAP = {
    1: "Agnostic",
    2: "Atheist",
    3: "Buddhist",
    4: "Christian (Catholic)",
    5: "Christian (Mormon)",
    6: "Christian (Protestant)",
    7: "Christian (Other)",
    8: "Hindu",
    9: "Jewish",
    10: "Muslim",
    11: "Sikh",
    12: "Other",
    0: "No response",
}
ORIENTATION_MAP = {
    1: "Heterosexual",
    2: "Bisexual",
    3: "Homosexual",
    4: "Asexual",
    5: "Other",
    0: "No response",
}
RACE_MAP = {
    10: "Asian",
    20: "Arab",
    30: "Black",
    40: "Indigenous Australian",
    50: "Native American",
    60: "White",
    70: "Other",
    0: "No response",
}
HAND_MAP = {1: "Right", 2: "Left", 3: "Ambidextrous", 0: "No response"}
VOTED_MAP = {1: "Yes", 2: "No", 0: "No response"}
MARRIED_MAP = {
    1: "Never married",
    2: "Currently married",
    3: "Previously married",
    0: "No response",
}
ENGNAT_MAP = {1: "Yes", 2: "No", 0: "No response"}
SCREENSIZE_MAP = {1: "Small screen", 2: "Large screen", 0: "No response"}
UNIQUE_NETWORK_MAP = {1: "Unique", 2: "Shared", 0: "No response"}
SOURCE_MAP = {
    1: "Front page of the site hosting the survey",
    2: "Google",
    3: "Other or Unknown",
    0: "No response",
}

# raw column -> (code map, output column)
RECODE_SPEC = {
    "gender": (GENDER_MAP, "gender_clean"),
    "education": (EDUCATION_MAP, "education_clean"),
    "urban": (URBAN_MAP, "urban_clean"),
    "religion": (RELIGION_MAP, "religion_clean"),
    "orientation": (ORIENTATION_MAP, "orientation_clean"),
    "race": (RACE_MAP, "race_clean"),
    "hand": (HAND_MAP, "hand_clean"),
    "voted": (VOTED_MAP, "voted_clean"),
    "married": (MARRIED_MAP, "married_clean"),
    "engnat": (ENGNAT_MAP, "engnat_clean"),
    "screensize": (SCREENSIZE_MAP, "screensize_clean"),
    "uniquenetworklocation": (UNIQUE_NETWORK_MAP, "uniquenetworklocation_clean"),
    "source": (SOURCE_MAP, "source_clean"),
}

# Scale item groupings (42-item questionnaire)
DEPRESSION_ITEMS = ["Q3A", "Q5A", "Q10A", "Q13A", "Q16A", "Q17A", "Q21A",
                    "Q24A", "Q26A", "Q31A", "Q34A", "Q37A", "Q38A", "Q42A"]
ANXIETY_ITEMS = ["Q2A", "Q4A", "Q7A", "Q9A", "Q15A", "Q19A", "Q20A",
                 "Q23A", "Q25A", "Q28A", "Q30A", "Q36A", "Q40A", "Q41A"]
STRESS_ITEMS = ["Q1A", "Q6A", "Q8A", "Q11A", "Q12A", "Q14A", "Q18A",
                "Q22A", "Q27A", "Q29A", "Q32A", "Q33A", "Q35A", "Q39A"]

# Personality items: reverse-scored items and (item, reversed item) pairs
TIPI_REVERSED = ["TIPI2", "TIPI4", "TIPI6", "TIPI8", "TIPI10"]
TIPI_TRAIT_PAIRS = {
    "Extraversion": ("TIPI1", "TIPI_R6"),
    "Agreeableness": ("TIPI7", "TIPI_R2"),
    "Conscientiousness": ("TIPI3", "TIPI_R8"),
    "Emotional Stability": ("TIPI_R4", "TIPI9"),
    "Openness": ("TIPI5", "TIPI_R10"),
}
TIPI_SCALE_MIN = 1
TIPI_SCALE_MAX = 7

# Vocabulary check: fake words
VCL_FAKE = ["VCL6", "VCL9", "VCL12"]

DASS_LABELS = {
    "Q1A": "Upset by trivial things",
    "Q2A": "Dryness of mouth",
    "Q3A": "No positive feelings",
    "Q4A": "Breathing difficulty",
    "Q5A": "Lack of motivation",
    "Q6A": "Over-reacting",
    "Q7A": "Shakiness",
    "Q8A": "Difficulty relaxing",
    "Q9A": "Anxious in situations",
    "Q10A": "Nothing to look forward to",
    "Q11A": "Easily upset",
    "Q12A": "Using nervous energy",
    "Q13A": "Sad and depressed",
    "Q14A": "Impatient when delayed",
    "Q15A": "Faintness",
    "Q16A": "Lost interest in everything",
    "Q17A": "Low self-worth",
    "Q18A": "Touchy",
    "Q19A": "Unexplained sweating",
    "Q20A": "Scared without reason",
    "Q21A": "Life not worthwhile",
    "Q22A": "Hard to wind down",
    "Q23A": "Difficulty swallowing",
    "Q24A": "No enjoyment",
    "Q25A": "Heart awareness",
    "Q26A": "Down-hearted",
    "Q27A": "Very irritable",
    "Q28A": "Close to panic",
    "Q29A": "Hard to calm down",
    "Q30A": "Fear trivial tasks",
    "Q31A": "No enthusiasm",
    "Q32A": "Irritated by interruptions",
    "Q33A": "Nervous tension",
    "Q34A": "Worthless",
    "Q35A": "Intolerant of delays",
    "Q36A": "Terrified",
    "Q37A": "Hopeless future",
    "Q38A": "Life meaningless",
    "Q39A": "Agitated",
    "Q40A": "Fear panic situations",
    "Q41A": "Trembling",
    "Q42A": "No initiative",
}
TIPI_LABELS = {
    "TIPI1": "Extraverted",
    "TIPI2": "Critical",
    "TIPI3": "Dependable",
    "TIPI4": "Anxious",
    "TIPI5": "Open to new experiences",
    "TIPI6": "Reserved",
    "TIPI7": "Sympathic",
    "TIPI8": "Disorganized",
    "TIPI9": "Calm",
    "TIPI10": "Conventional",
}
VCL_LABELS = {
    "VCL1": "boat",
    "VCL2": "incoherent",
    "VCL3": "pallid",
    "VCL4": "robot",
    "VCL5": "audible",
    "VCL6": "cuivocal",
    "VCL7": "paucity",
    "VCL8": "epistemology",
    "VCL9": "florted",
    "VCL10": "decide",
    "VCL11": "pastiche",
    "VCL12": "verdid",
    "VCL13": "abysmal",
    "VCL14": "lucid",
    "VCL15": "betray",
    "VCL16": "funny",
}

# Age bands: right-closed, lowest edge included
AGE_EDGES = [12, 17, 24, 34, 49, 100]
AGE_LABELS = [
    "Adolescents(13–17)",
    "Young Adults(18–24)",
    "Emerging Adults(25–34)",
    "Middle-aged Adults(35–49)",
    "Seniors(50+)",
]

# Anxiety severity bands: right-closed, lowest edge included
SEVERITY_EDGES = [0, 14, 18, 26, 34, 56]
SEVERITY_LABELS = ["Normal", "Mild", "Moderate", "Severe", "Extremely Severe"]

# Religion regrouping
RELIGION_GROUPS = {
    "Religious": [
        "Muslim",
        "Christian (Catholic)",
        "Christian (Protestant)",
        "Christian (Other)",
        "Christian (Mormon)",
        "Hindu",
        "Buddhist",
        "Jewish",
        "Sikh",
    ],
    "Non-religious": ["Agnostic", "Atheist"],
    "Unspecified": ["Other"],
}

# Quantile-group labels by number of groups
TERTILE_LABELS = ["Low", "Medium", "High"]
QUARTILE_LABELS = ["Low", "Medium-low", "Medium-high", "High"]

# Geographic key candidates probed in a country-boundary file, in order
GEO_KEY_CANDIDATES = ["iso_a3", "ISO_A3", "iso3", "ISO3", "ISO3166-1-Alpha-3", "id"]

# Missing-value tokens recognised by the delimited reader (pandas defaults)
DEFAULT_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Columns of the published tables, factors of the ANOVA, predictors of the models
OTHER_DEMOGRAPHIC_COLUMNS = ["age_clean", "country_name", "continent", "familysize"]
TARGET_COLUMNS = ["dassanxiety", "dassstress", "dassdepression", "dasssum"]
VCL_NEW_COLUMNS = ["vcl_valid", "vcl_invalid", "vcl_score"]
DEMOGRAPHIC_FACTORS = [
    "gender_clean",
    "orientation_clean",
    "married_clean",
    "urban_clean",
    "race_clean",
    "education_clean",
    "religion_grouped",
    "age_group",
]
REGRESSION_CATEGORICALS = [
    "gender_clean",
    "education_clean",
    "urban_clean",
    "married_clean",
    "religion_grouped",
    "race_clean",
]
PSYCHOLOGICAL_PREDICTORS = ["dassstress", "dassdepression"]
# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Derived names (built from the fixed values above)
DASS_ITEMS = [f"Q{i}A" for i in range(1, 43)]
TIPI_ITEMS = [f"TIPI{i}" for i in range(1, 11)]
VCL_ITEMS = [f"VCL{i}" for i in range(1, 17)]
VCL_REAL = [c for c in VCL_ITEMS if c not in VCL_FAKE]
TRAITS = list(TIPI_TRAIT_PAIRS)
TIPI_REVERSE = {item: item.replace("TIPI", "TIPI_R", 1) for item in TIPI_REVERSED}

SCORE_SPEC = {
    "dassdepression": DEPRESSION_ITEMS,
    "dassanxiety": ANXIETY_ITEMS,
    "dassstress": STRESS_ITEMS,
}

DEMOGRAPHIC_COLUMNS = [out for _, out in RECODE_SPEC.values()] + OTHER_DEMOGRAPHIC_COLUMNS
ANALYSIS_COLUMNS = DEMOGRAPHIC_COLUMNS + TARGET_COLUMNS + TRAITS + VCL_NEW_COLUMNS
STANDARDIZE_COLUMNS = ["age_clean", "familysize"] + TARGET_COLUMNS + TRAITS + ["vcl_score"]
NONRESPONSE_VARIABLES = [out for _, out in RECODE_SPEC.values()]
MODEL_NUMERIC = PSYCHOLOGICAL_PREDICTORS + TRAITS
MODEL_CATEGORICAL = list(DEMOGRAPHIC_FACTORS)
CORRELATION_COLUMNS = TARGET_COLUMNS + TRAITS


def quantile_labels(n_groups: int) -> list[str]:
    if n_groups == 3:
        return list(TERTILE_LABELS)
    if n_groups == 4:
        return list(QUARTILE_LABELS)
    return [f"G{i + 1}" for i in range(n_groups)]
