"""Word lists, lookup tables and constants that decide results."""

# --- Fixed values: orthography ------------------------------------------------
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# --- Fixed values: stop words -------------------------------------------------
LEXICAL_STOPWORDS = (
    "el la los las de del en a y o que un una por para con se su al es"
).split()

KEYWORD_STOPWORDS = "de la el en a los las del y o su".split()

OFF_TOPIC_STOPWORDS = (
    "para como cual cuales donde cuando porque porqué puede pueden debe deben esta este "
    "están esto una uno unos unas del las los que qué sobre según entre hace hacer tiene "
    "tienen ante ser son sea fue han más menos"
).split()

CONTENT_STOPWORDS = (
    "a al algo alguna algunas alguno algunos ante antes aquel aquella aquellas aquello "
    "aquellos asi aun aunque cada como con contra cual cuales cuando cuanto cuya cuyas cuyo "
    "cuyos de del desde donde dos el ella ellas ello ellos en entre era eran eres es esa esas "
    "ese eso esos esta estaba estan estar estas este esto estos fin fue fueron ha haber habia "
    "hacer hacia han hasta hay la las le les lo los mas mediante mientras muy ni no nos o para "
    "pero por porque que se sea sean segun ser si sin sino sobre solo son su sus tal tales tan "
    "tanto te toda todas todo todos tras un una unas uno unos y ya esten sera seran asimismo "
    "dicho dicha dichos dichas respectiva respectivo respectivas respectivos decir denomina "
    "denominan entendera entiende considera consideran corresponde corresponden"
).split()

DEFINITION_STOPWORDS = (
    "el la los las un una de del y o a que se en al lo su sus para por con"
).split()

# --- Fixed values: months -----------------------------------------------------
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
MONTH_CODES = {
    "ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AGO": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DIC": 12,
}

# --- Fixed values: ranking ----------------------------------------------------
RRF_K = 60
LEXICAL_POOL = 50
DENSE_POOL = 50
SIMPLE_RERANK = 10
COMPLEX_RERANK = 15
SIMPLE_TOP_K = 5
COMPLEX_TOP_K = 10
EDGE_BOOST = {
    "define_termino": 2.0, "aplica": 2.0, "modifica": 1.5, "cita": 1.3, "menciona": 1.2,
    "remite": 1.3, "complementa": 1.4, "deroga": 1.5, "referencia_implicita": 1.1,
}
ALIAS_DEFINITION_BONUS = 10.0
BASE_NORM_BONUS = 0.3
RECENCY_START, RECENCY_SPAN, RECENCY_WEIGHT = 1935, 90.0, 0.9
INJECTED_SCORE = 9999.0
DEFINER_BOOST, REFERRER_BOOST = 2.0, 1.3
COMPLIANCE_THRESHOLD = -3.0

# --- Fixed values: references and definitions ----------------------------------
CONFIDENCE_ARTICLE_REF = 0.90
CONFIDENCE_NORM_REF = 0.85
CONFIDENCE_ALIAS_REF = 0.85
CONFIDENCE_CONCEPT_REF = 0.90
CONFIDENCE_POSITIONAL_REF = 0.70
MIN_EXTRA_WORDS = 4
MAX_CANONICAL_EXTRA_WORDS = 8
RANK_LEGAL, RANK_DECREE, RANK_RESOLUTION = 3, 2, 1
OFF_TOPIC_RATIO = 0.5
PROMPT_BUDGET = 45000
PROMPT_SEPARATOR = 2
STRICT_RECALL = 0.6
HANG_MS = 300000
REFUSAL = "no encuentro esa información"

# --- Fixed values: themes -------------------------------------------------------
THEME_STEMS = [
    ("DISTRIBUCION", ["distribuci"]),
    ("TRANSMISION", ["transmisi"]),
    ("GENERACION", ["generaci"]),
    ("MEDICION", ["medid", "medici"]),
    ("PEAJES", ["peaje"]),
    ("SSCC", ["complementari"]),
    ("TARIFAS", ["tarifa"]),
    ("POTENCIA", ["potencia"]),
    ("ENERGIA", ["energia", "energía"]),
    ("COORDINADOR", ["coordinador"]),
    ("TRANSFERENCIAS", ["transferencia"]),
]
SECTOR_STEMS = (
    "electri energi energía transmisi distribuci generaci potencia tarifa peaje coordinador "
    "medidor suministro voltaje tension kwh mwh cne sec cdec sing sic"
).split()
THEME_CLUSTERS = {
    "Transmisión Sistema": ["TRANSMISION", "PEAJES", "TARIFAS"],
    "Generación y Venta": ["GENERACION", "ENERGIA", "POTENCIA"],
    "Distribución": ["DISTRIBUCION", "MEDICION", "TARIFAS"],
    "Operación Sistema": ["SSCC", "COORDINADOR", "TRANSFERENCIAS"],
}
TECHNICAL_TERMS = (
    "potencia suficiencia transferencias coordinador generador transmisor distribuidor sscc "
    "central decreto ley resolución reglamento"
).split()

# --- Fixed values: relation kinds ------------------------------------------------
EDGE_KINDS = ["cita", "define_termino", "remite", "aplica", "modifica", "complementa", "deroga",
              "referencia_implicita"]
EDGE_METHODS = ["regex", "llm", "manual"]
NORM_TYPES = ["LEY", "DECRETO", "DFL", "DL", "RESOLUCION", "AUTO", "OTRO"]
NORM_STATES = ["VIGENTE", "DEROGADA", "MODIFICADA", "DESCONOCIDO"]
