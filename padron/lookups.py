"""Fixed values. They are inputs to the results and must stay as they are."""

from __future__ import annotations

# --- Territories -----------------------------------------------------------

# Rows that are not one of the compared territories.
EXCLUDED_REGIONS = ("TOTAL", "Sin territorializar", "Ceuta", "Melilla")

ALL_REGIONS = "Todas las CCAA"
ALL_REGIONS_LABEL = {"ES": "Todas las CCAA", "EN": "All Regions"}

# The official territory names, in selector order.
REGIONS = (
    "Andalucía",
    "Aragón",
    "Asturias, Principado de",
    "Balears, Illes",
    "Canarias",
    "Cantabria",
    "Castilla y León",
    "Castilla-La Mancha",
    "Cataluña",
    "Comunitat Valenciana",
    "Extremadura",
    "Galicia",
    "Madrid, Comunidad de",
    "Murcia, Región de",
    "Navarra, Comunidad Foral de",
    "País Vasco",
    "Rioja, La",
)

# Licence-side key -> spend-side key, both without accents.
REGION_KEYS = {
    "asturias, principado de": "asturias (principado de)",
    "balears, illes": "balears (illes)",
    "madrid, comunidad de": "madrid (comunidad de)",
    "murcia, region de": "murcia (region de)",
    "navarra, comunidad foral de": "navarra (comunidad foral de)",
    "rioja, la": "rioja (la)",
}

# Words in a question -> official name; the first hit wins.
REGION_ALIASES = (
    ("andalucia", "Andalucía"),
    ("aragon", "Aragón"),
    ("asturias", "Asturias, Principado de"),
    ("baleares", "Balears, Illes"),
    ("balears", "Balears, Illes"),
    ("canarias", "Canarias"),
    ("cantabria", "Cantabria"),
    ("leon", "Castilla y León"),
    ("mancha", "Castilla - La Mancha"),
    ("cataluña", "Cataluña"),
    ("catalunya", "Cataluña"),
    ("catalonia", "Cataluña"),
    ("valencia", "Comunitat Valenciana"),
    ("valenciana", "Comunitat Valenciana"),
    ("extremadura", "Extremadura"),
    ("galicia", "Galicia"),
    ("madrid", "Madrid, Comunidad de"),
    ("murcia", "Murcia, Región de"),
    ("navarra", "Navarra, Comunidad Foral de"),
    ("vasco", "País Vasco"),
    ("rioja", "Rioja, La"),
)

# --- Home indicators -------------------------------------------------------

LICENCE_FILE = "federado_01.csv"
SPEND_FILE = "gasto_03.csv"
SPEND_INDICATOR = "Gasto medio por hogar (Euros)"
ALL_FEDERATIONS = "TOTAL"

REGION_COL = "CCAA"
SPEND_COL = "Gasto_Promedio_Hogar_Eur"
LICENCES_COL = "Licencias_Federadas"
ACTIVE_COL = "Poblacion_Activa_Dep"

# Header spellings -> canonical column of each lake table.
LICENCE_HEADERS = {
    "federacion": ["Federación", "Federacion"],
    "comunidad_autonoma": ["Comunidad autónoma", "Comunidad autonoma"],
    "periodo": ["periodo"],
    "total_raw": ["Total"],
}
SPEND_HEADERS = {
    "indicador": ["Indicador"],
    "comunidad_autonoma": ["Comunidad autónoma", "Comunidad autonoma"],
    "periodo": ["periodo"],
    "total_raw": ["Total"],
}

# Table headings by language.
TABLE_LABELS = {
    "ES": {
        REGION_COL: "CCAA",
        SPEND_COL: "Gasto Promedio Hogar Eur",
        LICENCES_COL: "Licencias Federadas",
    },
    "EN": {
        REGION_COL: "Region",
        SPEND_COL: "Avg Household Spending Eur",
        LICENCES_COL: "Federated Licenses",
    },
}

# --- Questions and answers -------------------------------------------------

# Phrases per intent; the intents are tried in this order.
INTENT_PATTERNS = (
    ("max_spend", ("gasta mas", "maximo gasto", "most spending", "highest spending", "mas dinero")),
    ("min_spend", ("gasta menos", "minimo gasto", "least spending", "lowest spending")),
    ("max_licences", ("mas licencias", "most licenses", "mas federados", "mas socios")),
)

# Answer texts by language.
ANSWER_LABELS = {
    "ES": {
        "chat_max_spend": "🔍 La CCAA que más gasta es {region} con {value} €.",
        "chat_min_spend": "🔍 La CCAA que menos gasta es {region} con {value} €.",
        "chat_max_lic": "🏆 {region} lidera en licencias con {value:,}.",
        "chat_single_region": "📍 En {region}: Gasto de {gasto} € y {lic} licencias.",
        "chat_analyze": "🧠 He analizado los datos actuales:",
        "chat_error_data": "⚠️ No hay datos disponibles para el análisis.",
    },
    "EN": {
        "chat_max_spend": "🔍 The region with the highest spending is {region} with {value} €.",
        "chat_min_spend": "🔍 The region with the lowest spending is {region} with {value} €.",
        "chat_max_lic": "🏆 {region} leads in licenses with {value:,}.",
        "chat_single_region": "📍 In {region}: Spending of {gasto} € and {lic} licenses.",
        "chat_analyze": "🧠 I have analyzed the current data:",
        "chat_error_data": "⚠️ No data available for analysis.",
    },
}

# Text shown instead of an answer; every language but ES gets EN.
BLOCKED_ES = (
    "⚠️ El mensaje ha sido bloqueado por nuestra política de seguridad "
    "debido a lenguaje tóxico o inapropiado."
)
BLOCKED_EN = (
    "⚠️ The message has been blocked by our security policy "
    "due to toxic or inappropriate language."
)

# --- Moderation ------------------------------------------------------------

# The blocklist.
BLOCKED_TERMS = (
    "puta", "puto", "putos", "putas",
    "hijo de puta", "hija de puta",
    "inutil", "imbecil", "idiota", "gilipollas",
    "capullo", "mamona", "mamon", "culo",
    "mierda", "hostia", "joder", "cono",
    "pendejo", "cabron", "cabrona", "zorra",
    "fuck", "shit", "asshole", "bitch", "damn",
)

TOXIC_THRESHOLD = 0.7
TOXIC_MAX_TOKENS = 128

# --- Records ---------------------------------------------------------------

SEED = 42
SAMPLE_CAP = 40
CHAT_MAX_TOKENS = 1024

# Fixed value: the system turn of every generated record.
SYSTEM_PROMPT = (
    "Eres un experto analista de estadísticas deportivas de España. "
    "Tienes acceso a datos del Ministerio de Educación, FP y Deporte sobre "
    "deporte federado, gasto en deporte, hábitos deportivos, empleo en el sector "
    "y empresas deportivas. Respondes siempre en español de forma clara y precisa."
)

# Lake folder -> record family.
CATEGORY_FAMILY = {
    "deporte_federado": "federated",
    "empleo_deporte": "employment",
    "empresa_deporte": "company",
    "gasto_hogares": "spend",
    "gasto_publico": "spend",
    "habitos_deportivos": "habits",
    "indicadores_afiliacion": "affiliation",
    "indicadore_armonizacion_eu": "eu",
}

ZONE_COL = "Comunidad autónoma y tamaño del municipio"

# Header variants of one dimension across survey waves.
LAKE_HEADERS = {
    ZONE_COL: [
        "Comunidad autónoma y tamaño del municipio",
        "Comunidad autónoma y tamaño de municipio",
        "Comunidad autónoma-tamaño de municipio",
        "Tamaño del municipio",
    ],
    "Motivos": ["Motivos", "Causa"],
}

# Cells that a tabular reader takes as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# The sentences of question-answer records, by family. A name in braces stands for a
# value, or for an optional clause of ``CLAUSES`` that is left out where its value is missing.
SENTENCES = {
    "federated": (
        "¿Cuántos {asked}{sex}{where} en {period}?",
        "El número de {named}{where} en el periodo {period} fue de {total}.",
    ),
    "spend": (
        "¿Cuál fue el {what}{where}{kind}{when}?",
        "El {what}{where}{kind}{when} fue de {total}.",
    ),
    "employment": (
        "¿Cuál fue el valor de '{what}'{profile_asked} en {period}?",
        "El indicador '{what}'{profile_told} en {period} registró un valor de {total}.",
    ),
    "company": (
        "¿Qué valor tuvo '{what}'{activity_asked} en {period}?",
        "El indicador '{what}'{activity_told} en {period} fue de {total}.",
    ),
    "habits": (
        "¿Cuál fue el porcentaje de '{what}' en {zone} (encuesta {year})?",
        "Según la encuesta de hábitos deportivos de {year}, el indicador '{what}' en {zone} fue del"
        " {total}%.",
    ),
    "affiliation": (
        "¿Cuál fue el indicador de '{kind}' para {sex_asked}actividad '{activity}' en {period}?",
        "El indicador '{kind}' {sex_told}en {period} fue de {total}.",
    ),
    "eu": (
        "¿Cuál fue el valor de '{what}' en {country}{profile_asked} ({period})?",
        "El indicador armonizado '{what}' en {country}{profile_told} en {period} fue de {total}.",
    ),
}
CLAUSES = {
    "federated": {
        "asked": "deportistas de {}", "named": "deportistas de la federación {}",
        "sex": " ({})", "where": " en {}",
    },
    "spend": {"where": " en {}", "kind": " para '{}'", "when": " en {}"},
    "employment": {"profile_asked": " para {}", "profile_told": " para el perfil {}"},
    "company": {
        "activity_asked": " en la actividad {}", "activity_told": " para la actividad económica {}",
    },
    "affiliation": {"sex_asked": "{}, ", "sex_told": "para {} "},
    "eu": {"profile_asked": ", {}", "profile_told": " para {}"},
}
# What stands for a missing value.
SENTENCE_DEFAULTS = {
    "asked": "deportistas federados", "named": "deportistas", "spend": "gasto deportivo",
    "employment": "empleo deportivo", "company": "empresas deportivas", "zone": "España",
    "habits": "hábito deportivo", "affiliation": "afiliación", "eu": "indicador EU",
}
