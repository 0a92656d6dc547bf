"""Fixed schemas and domain constants of the signal store.

Everything in the "fixed values" blocks must equal the reference
application's values for results to match; they are stated here once,
in their natural order, and imported everywhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------

# Column order of a cleaned signal row (dataset_id is assigned at load time).
SIGNAL_COLUMNS = [
    "date", "year", "month", "customer_action", "sentiment_score",
    "sentiment_label", "source", "company", "product_service", "text",
    "country", "rating",
]

SIGNAL_TYPES: dict[str, T.DataType] = {
    "date": T.DateType(),
    "year": T.IntegerType(),
    "month": T.IntegerType(),
    "customer_action": T.StringType(),
    "sentiment_score": T.DoubleType(),
    "sentiment_label": T.StringType(),
    "source": T.StringType(),
    "company": T.StringType(),
    "product_service": T.StringType(),
    "text": T.StringType(),
    "country": T.StringType(),
    "rating": T.DoubleType(),
}

SIGNALS_SCHEMA = T.StructType(
    [T.StructField("dataset_id", T.LongType(), True)]
    + [T.StructField(c, SIGNAL_TYPES[c], True) for c in SIGNAL_COLUMNS]
)

DATASETS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("loaded_at", T.TimestampType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("source_path", T.StringType(), True),
    T.StructField("source_mtime", T.TimestampType(), True),
])

# Ids given to staged files, and files that could not be imported.
ALLOCATIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("source_path", T.StringType(), True),
    T.StructField("source_mtime", T.TimestampType(), True),
])
REJECTED_SCHEMA = T.StructType([
    T.StructField("source_path", T.StringType(), True),
    T.StructField("source_mtime", T.TimestampType(), True),
    T.StructField("reason", T.StringType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference application's)
# ---------------------------------------------------------------------------

# Action sets.
COMPLAINT_OR_CHURN_ACTIONS = [
    "complaining", "formal_complaint", "churning",
    "churning_due_to_price", "churning_due_to_policy", "venting",
]
CHURN_ACTIONS = ["churning", "churning_due_to_price", "churning_due_to_policy"]
CHURN_CAUSE_LABELS = {
    "churning": "Insatisfacción General",
    "churning_due_to_price": "Por Precio",
    "churning_due_to_policy": "Por Política",
}
PRECHURN_ACTIONS = [
    "searching_for_alternatives", "reacting_to_price_change",
    "reacting_to_policy_change",
]
COMPLAINT_ACTIONS = ["complaining", "formal_complaint"]
VALID_ACTIONS = [
    "formal_complaint", "complaining", "churning",
    "churning_due_to_price", "churning_due_to_policy",
    "positive_review", "negative_review", "advocating",
    "seeking_help", "venting", "sharing_positive_experience",
    "searching_for_alternatives", "reacting_to_price_change",
    "reacting_to_policy_change", "neutral_review",
    "researching", "discussing",
]

# Month labels, January first.
MONTH_LABELS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun",
                "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]

# Country prefixes removed by the state map (hyphen, then en dash).
US_PREFIXES = ["United States - ", "United States – "]

# Sources considered regulatory.
REGULATORY_SOURCE = "CFPB"

# Mobile store predicate: lower(source) LIKE any of these.
MOBILE_SOURCE_PATTERNS = ["%appstore%", "%google%play%"]

# Keyword topics over negative texts (substring regex on lower-cased text).
COMPLAINT_TOPICS = [
    ("Cobros / Cargos Incorrectos",
     r"cobro|cargo|tarifa|interes|recargo|billing|charge|fee|overcharg|interest|payment|factura|price"),
    ("Atención al Cliente",
     r"atencion|soporte|ejecutivo|ayuda|espera|support|call|wait|agent|help|service|representative|phone|rude|unhelpful"),
    ("Reporte Crediticio",
     r"credito|credit|report|score|bureau|equifax|experian|transunion|dispute|inaccurate"),
    ("Gestión de Cuenta",
     r"cuenta|account|cierre|closed|freeze|block|fraud|identity|stolen|unauthorized"),
    ("Préstamos / Hipotecas",
     r"prestamo|mortgage|loan|hipoteca|foreclosure|modification|payment plan|deuda|debt|collector"),
    ("App / Acceso Digital",
     r"app|web|login|password|online|digital|portal|slow|crash|error|bug|glitch"),
]
APP_ISSUE_TOPICS = [
    ("Fallas (Crash)", r"crash|crashea|caída|caida|cierra|close|quit"),
    ("Lentitud (Slow)", r"lento|lentitud|demora|delay|slow|lag"),
    ("Errores (Bugs)", r"error|falla|bug|glitch|problem"),
    ("Acceso (Login)", r"login|entrar|password|clave|usuario|access"),
]

# Stakeholder tabs: allowed sources (None = all) and visible filter columns.
ALL_FILTER_COLUMNS = ["source", "company", "product", "action", "sentiment"]
TAB_CONFIG = {
    "marketing": {
        "sources": ["Reddit", "HackerNews", "Trustpilot", "GDELT",
                    "Google_Trends", "AppStore", "GooglePlay"],
        "visible": ["source", "product", "action", "sentiment"],
    },
    "direction": {
        "sources": None,
        "visible": ["source", "company", "product", "action", "sentiment"],
    },
    "retention": {
        "sources": ["CFPB", "Trustpilot"],
        "visible": ["source", "product", "action", "sentiment"],
    },
    "product": {
        "sources": ["AppStore", "GooglePlay"],
        "visible": ["source", "product", "sentiment"],
    },
}

# Default period of the "range" mode.
DEFAULT_YEAR_FROM = 2010
DEFAULT_YEAR_TO = 2027

# Facet thresholds (minimum count, inclusive) and caps.
FACET_MIN_COUNT = {"year": 1, "source": 100, "company": 500,
                   "product": 1000, "action": 10}
FACET_CAP = {"company": 30, "product": 20}
FACET_LABEL_WIDTH = {"company": 45, "product": 50}

# Ingest: file extensions and their priority when one file must be chosen.
DATA_EXTENSIONS = [".parquet", ".csv", ".json", ".jsonl"]
HIDDEN_PREFIXES = (".", "__", "~")
RECOVERED_DATASET_NAME = "Datos sin registrar (recuperado)"
ORPHAN_DATASET_NAME = "Dataset {id} (recuperado)"
