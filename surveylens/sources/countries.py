"""The country dimension ``(alpha2, alpha3, name, continent, common_name)`` used when a survey run gets none.

Codes and English names come from the JVM's ISO 3166 tables; only what these
lack is stated here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: ISO 3166-1 alpha-2 codes by continent (Antarctica and a few territories have none)
CONTINENTS = {
    "Africa": "AO BF BI BJ BW CD CF CG CI CM CV DJ DZ EG ER ET GA GH GM GN GQ GW KE KM LR LS LY MA MG ML MR MU MW MZ "
              "NA NE NG RE RW SC SD SH SL SN SO SS ST SZ TD TG TN TZ UG YT ZA ZM ZW",
    "Asia": "AE AF AM AZ BD BH BN BT CC CN CX CY GE HK ID IL IN IO IQ IR JO JP KG KH KP KR KW KZ LA LB LK MM MN MO MV "
            "MY NP OM PH PK PS QA SA SG SY TH TJ TM TR TW UZ VN YE",
    "Europe": "AD AL AT AX BA BE BG BY CH CZ DE DK EE ES FI FO FR GB GG GI GR HR HU IE IM IS IT JE LI LT LU LV MC MD "
              "ME MK MT NL NO PL PT RO RS RU SE SI SJ SK SM UA",
    "North America": "AG AI AW BB BL BM BQ BS BZ CA CR CU CW DM DO GD GL GP GT HN HT JM KN KY LC MF MQ MS MX NI PA "
                     "PM PR SV TC TT US VC VG VI",
    "Oceania": "AS AU CK FJ FM GU KI MH MP NC NF NR NU NZ PF PG PW SB TK TO TV VU WF WS",
    "South America": "AR BO BR CL CO EC FK GF GS GY PE PY SR UY VE BV HM",
}

# fixed values: ISO short names where the JVM says otherwise
NAMES = {
    "BN": "Brunei Darussalam", "BO": "Bolivia, Plurinational State of", "CD": "Congo, The Democratic Republic of the",
    "CG": "Congo", "CV": "Cabo Verde", "FM": "Micronesia, Federated States of", "IR": "Iran, Islamic Republic of",
    "KP": "Korea, Democratic People's Republic of", "KR": "Korea, Republic of", "LA": "Lao People's Democratic Republic",
    "MD": "Moldova, Republic of", "PS": "Palestine, State of", "RU": "Russian Federation", "SY": "Syrian Arab Republic",
    "TW": "Taiwan, Province of China", "TZ": "Tanzania, United Republic of", "VE": "Venezuela, Bolivarian Republic of",
    "VN": "Viet Nam", "HK": "Hong Kong", "MO": "Macao", "MM": "Myanmar", "BA": "Bosnia and Herzegovina",
    "TT": "Trinidad and Tobago", "AG": "Antigua and Barbuda", "TR": "T\u00fcrkiye", "CI": "C\u00f4te d'Ivoire",
}


#: Columns under which a country can be asked for, in order of precedence.
ALIASES = ("name", "official_name", "common_name", "alpha2", "alpha3")


def country_dimension(spark: SparkSession) -> DataFrame:
    """One row per ISO 3166-1 country (about 250)."""
    jvm = spark.sparkContext._jvm
    english = jvm.java.util.Locale.ENGLISH
    continent = {code: name for name, codes in CONTINENTS.items() for code in codes.split()}
    rows = []
    for code in jvm.java.util.Locale.getISOCountries():
        place = jvm.java.util.Locale("", code)
        common = place.getDisplayCountry(english)
        rows.append((code, place.getISO3Country(), NAMES.get(code, common), continent.get(code), common))
    return spark.createDataFrame(rows, "alpha2 string, alpha3 string, name string, continent string, common_name string")
