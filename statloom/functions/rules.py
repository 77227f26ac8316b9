"""Rule lists used by the operators.

Every operator takes its rules as a parameter whose default is one of the values below, so a caller
can pass a different list without touching an operator.
"""

# ---------------------------------------------------------------------------------------------
# Target period and limits
# ---------------------------------------------------------------------------------------------
PERIOD_START = 2018
PERIOD_END = 2025
EXTENDED_START = 2010
EXTENDED_END = 2030
DEFAULT_YEAR = 2024
MAX_CONTENT_CHARS = 500000
MIN_CONTENT_CHARS = 10

# ---------------------------------------------------------------------------------------------
# Source catalogue (group -> URLs)
# ---------------------------------------------------------------------------------------------
SOURCES = {
    "government_accessible": [
        "https://www.bct.gov.tn/bct/siteprod/francais/index.jsp",
        "https://www.ins.tn/fr",
        "https://www.finances.gov.tn/fr",
    ],
    "international_tunisia_data": [
        "https://api.worldbank.org/v2/countries/TN/indicators/NY.GDP.MKTP.CD?format=json&date=2020:2023",
        "https://api.worldbank.org/v2/countries/TN/indicators/FP.CPI.TOTL.ZG?format=json&date=2020:2023",
        "https://api.worldbank.org/v2/countries/TN/indicators/SL.UEM.TOTL.ZS?format=json&date=2020:2023",
        "https://restcountries.com/v3.1/name/tunisia",
    ],
    "economic_data_reliable": [
        "https://tradingeconomics.com/tunisia/gdp",
        "https://www.cia.gov/the-world-factbook/countries/tunisia/",
    ],
    "emergency_fallback": [
        "https://httpbin.org/json",
        "https://api.worldbank.org/v2/countries?format=json&per_page=300",
    ],
}

# ---------------------------------------------------------------------------------------------
# URL and domain terms
# ---------------------------------------------------------------------------------------------
URL_API = ["api.", "/api/", ".json", "format=json"]
DOMAIN_NATIONAL = ["bct.gov.tn", "ins.tn", "finances.gov.tn"]
DOMAIN_INTERNATIONAL = ["api.worldbank.org", "data.worldbank.org", "imf.org"]
DOMAIN_GOV = ["bct.gov.tn", "ins.tn", "finances.gov.tn", ".gov.tn"]
URL_DOCUMENT_ENDINGS = [".pdf", ".xlsx", ".xls", ".doc", ".docx"]
DOMAIN_COMMERCIAL = ["industrie", "commerce", "business"]
SITE_TYPES = [
    ("ins.tn", "statistical_institute"),
    ("bct.gov.tn", "central_bank"),
    ("finances.gov.tn", "ministry_finance"),
    ("tunisieindustrie", "industry_portal"),
    (".gov.tn", "government"),
]
PRIMARY_TYPE_GOV = ["gov.tn", "bct", "ins"]
DOMAIN_POLICY = [
    ("bct.gov.tn", 300),
    ("ins.tn", 240),
    ("finances.gov.tn", 200),
    (".gov.tn", 200),
    ("api.worldbank.org", 60),
    ("restcountries.com", 30),
]
DOMAIN_POLICY_DEFAULT = 180
ROUTE_COORD_API = ["api.", "/api/", "format=json", "format=xml", "restcountries"]
ROUTE_COORD_DYNAMIC = [".jsp", ".asp", ".php", "javascript:", "tableau"]
ROUTE_GRAPH_API = [
    "api.worldbank.org", "restcountries.com", "opendata", "data.gov", "/api/",
    "format=json", "format=xml", "format=csv",
]
ROUTE_AGENT_API = ["api.", "/api/", ".json", "worldbank.org"]
MODEL_URL_ON = ["bct.gov.tn", "ins.tn", "actualites"]
MODEL_URL_COMPLEX = ["bct.gov.tn", "ins.tn"]
LINK_EXCLUDED = [
    "contact", "about", "login", "admin", "search", "sitemap",
    "css", "js", "img", "pdf", "doc", "media", "archive",
    "facebook", "twitter", "linkedin", "youtube", "instagram",
]
LINK_BINARY_ENDINGS = [".pdf", ".doc", ".xls", ".zip", ".jpg", ".png", ".gif"]
LINK_PRIORITY = [
    "statistique", "données", "indicateur", "rapport", "publication",
    "économie", "finance", "social", "démographie", "emploi",
    "pib", "inflation", "commerce", "industrie",
]
DATA_LINK_WORDS = ["statistique", "donnee", "data", "excel", "csv", "pdf"]

# ---------------------------------------------------------------------------------------------
# units
# ---------------------------------------------------------------------------------------------
UNIT_PATTERNS = [
    (r"%|pourcent", "%"),
    (r"md|millions?\s*de?\s*dinars?", "MD"),
    (r"milliards?", "MD"),
    (r"usd|dollars?", "USD"),
    (r"eur|euros?", "EUR"),
    (r"habitants?", "habitants"),
]
UNIT_PATTERNS_CLEAN = [
    (r"%|pourcent|pourcentage", "%"),
    (r"md|millions?\s*de?\s*dinars?", "MD"),
    (r"milliards?", "Milliards"),
    (r"millions?", "Millions"),
    (r"usd|dollars?", "USD"),
    (r"eur|euros?", "EUR"),
    (r"habitants?", "Habitants"),
]
UNIT_BY_NAME_CLEAN = [
    (["taux", "inflation", "chomage"], "%"),
    (["pib", "dette", "budget"], "MD"),
    (["population"], "Habitants"),
]
UNIT_STANDARD = [
    ("pourcent", "%"),
    ("pourcentage", "%"),
    ("millions de dinars", "MD"),
    ("milliards", "MD"),
    ("dollar", "USD"),
    ("euro", "EUR"),
]
UNIT_DESCRIPTION = {
    "MD": "Millions de Dinars",
    "MDT": "Millions de Dinars Tunisiens",
    "%": "Pourcentage",
    "USD": "Dollars Américains",
    "EUR": "Euros",
    "TND": "Dinars Tunisiens",
    "habitants": "Nombre d'habitants",
}
RECOGNIZED_UNITS = [
    ("md", "millions de dinars"),
    ("milliers", "milliers"),
    ("dinars courants", "dinars courants"),
    ("dinars de 2015", "dinars constants 2015"),
    ("%", "pourcentage"),
    ("tnd", "dinars tunisiens"),
    ("usd", "dollars américains"),
    ("eur", "euros"),
]
VALID_UNIT_EXTRAS = ["unknown", "percentage", "millions_dinars"]

# ---------------------------------------------------------------------------------------------
# Year patterns
# ---------------------------------------------------------------------------------------------
PERIOD_YEAR = r"20(?:1[8-9]|2[0-5])"
YEAR_NAME_PATTERNS = [
    r"\b(20(?:1[8-9]|2[0-5]))\b",
    r"tunisia\s+(\d{4})",
    r"gdp.*?(\d{4})",
    r"(\d{4})\s*$",
    r"(\d{4})\s*[)\]\}]",
    r"current.*?(\d{4})",
]
YEAR_TEXT_PATTERNS = [
    r"year[:\s]+(\d{4})",
    r"année[:\s]+(\d{4})",
    r"en\s+(\d{4})",
    r"for\s+(\d{4})",
    r"(\d{4})\s+data",
    r"statistics.*?(\d{4})",
]
YEAR_HEADER_PATTERNS = [
    r"tunisia.*?(\d{4})",
    r"gdp.*?(\d{4})",
    r"economic.*?(\d{4})",
    r"statistics.*?(\d{4})",
    r"report.*?(\d{4})",
    r"data.*?(\d{4})",
]
YEAR_CONTEXT_PATTERNS = [
    r"tunisia[^0-9]*(\d{4})",
    r"tunisie[^0-9]*(\d{4})",
    r"gdp[^0-9]*tunisia[^0-9]*(\d{4})",
    r"data[^0-9]*(\d{4})",
    r"year[:\s]+(\d{4})",
    r"statistics[^0-9]*(\d{4})",
]
YEAR_WIDE_NAME_PATTERNS = [
    r"tunisia\s+(\d{4})",
    r"gdp.*?tunisia.*?(\d{4})",
    r"(\d{4})\s*$",
    r"\b(20(?:1[8-9]|2[0-5]))\b",
    r"([0-9]{4})",
]
YEAR_JSON_PATTERNS = [
    r'"date":\s*"(\d{4})"',
    r'"year":\s*"?(\d{4})"?',
    r'"(\d{4})":\s*\{',
]

# ---------------------------------------------------------------------------------------------
# Indicator names, categories and terms
# ---------------------------------------------------------------------------------------------
CATEGORY_GROUPS = [
    (["taux directeur", "taux d'intérêt", "tmm", "inflation", "déflation"], "MONETARY"),
    (["population", "démographie", "emploi", "chômage", "unemployment"], "DEMOGRAPHIC"),
    (["exportations", "importations", "balance commerciale", "exports", "imports"], "TRADE"),
    (["pib", "gdp", "dette publique", "déficit budgétaire", "budget deficit"], "FISCAL"),
    (["réserves", "change", "bourse", "indice", "reserves", "exchange rate"], "FINANCIAL"),
]
CATEGORY_GROUPS_CLEAN = [
    (["pib", "gdp", "produit"], "FISCAL"),
    (["inflation", "prix"], "MONETARY"),
    (["chomage", "emploi", "population"], "DEMOGRAPHIC"),
    (["export", "import", "commerce"], "TRADE"),
]
TARGET_TERMS = [
    "pib", "gdp", "inflation", "taux directeur", "chômage",
    "population", "dette", "export", "import", "balance",
]
GENERAL_EXCLUDE = r"^(?:(?:table|tableau|total|somme)|(?:année|year|date)|[0-9]{4})"
GENERAL_TERMS = [
    "pib", "gdp", "inflation", "taux", "dette", "budget",
    "population", "emploi", "chômage", "export", "import",
    "réserves", "change", "crédit", "épargne", "formation",
]
OFFICE_TERMS = [
    "épargne", "formation", "capital", "investissement",
    "population", "emploi", "chômage", "entreprises",
]
CLEAN_EXCLUDE_PATTERNS = [
    r"(?:table|tableau|header|entete|titre)$",
    r"(?:th|td|tr|tbody|thead)$",
    r"(?:column|colonne|ligne|row)$",
    r"(?:total|sous[-\s]?total|somme|sum)$",
    r"(?:moyenne|mean|average|moy)$",
    r"(?:min|max|minimum|maximum)$",
    r"(?:19|20)[0-9]{2}$",
    r"annee?\s*(?:19|20)[0-9]{2}$",
    r"(?:janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)$",
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$",
    r"[0-9]{1,2}[/-][0-9]{1,2}[/-]?[0-9]{0,4}$",
    r"(?:suivant|precedent|next|previous|suite|fin|debut)$",
    r"(?:page|p\.|p\s[0-9]+)$",
    r"<[^>]+>",
    r"\s*class\s*=",
    r"\s*id\s*=",
    r"javascript:|css:|style\s*=",
]
CLEAN_VALID_TERMS = [
    "pib", "gdp", "produit interieur brut", "gross domestic product",
    "inflation", "deflation", "prix", "prices",
    "taux", "rate", "pourcentage", "percentage",
    "chomage", "unemployment", "emploi", "employment",
    "population", "demographie", "demographic",
    "natalite", "mortalite", "birth", "death",
    "export", "exportation", "import", "importation",
    "commerce", "trade", "balance commerciale", "trade balance",
    "production", "industrie", "industry", "manufacturing",
    "budget", "dette", "debt", "deficit", "surplus",
    "recettes", "revenues", "depenses", "expenses",
    "impot", "tax", "fiscal",
    "monetaire", "monetary", "banque", "bank",
    "credit", "pret", "loan", "taux directeur",
    "reserves", "liquidite", "liquidity",
]
CLEAN_RELATED_TERMS = [
    "economique", "economic", "financier", "financial",
    "social", "industriel", "commercial", "monetaire",
]
STRICT_REJECT_PATTERNS = [
    r"(?:19|20)[0-9]{2}$",
    r"(?:tableau|table|total|somme|sum)$",
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$",
    r"(?:source|note|reference|ref)[:.]",
    r"(?:en|in|de|du|des|le|la|les|et|and|or|ou)\s",
    r"classe|category|type|kind|sort",
    r"html|css|javascript|script|div|span|class",
    r"[<>].*[<>]$",
]
STRICT_TERMS = [
    "pib", "gdp", "inflation", "taux", "chomage", "emploi",
    "population", "demographie", "export", "import", "commerce",
    "industrie", "production", "investissement", "dette", "deficit",
    "budget", "recettes", "depenses", "croissance", "development",
    "gross domestic product", "unemployment", "trade", "economy",
    "economic", "financial", "monetary", "fiscal", "statistics",
    "indicator", "index", "rate", "percentage", "billion", "million",
    "annual", "quarterly", "growth", "development", "social",
    "demographic", "tunisia", "tunisian", "tn", "country", "national",
    "current", "constant", "real", "nominal",
]
STRICT_CONTEXT_TERMS = ["data", "value", "measure", "metric", "figure", "amount"]
UNDATED_TERMS = [
    "pib", "gdp", "inflation", "unemployment", "chomage",
    "population", "export", "import", "trade", "commerce",
    "budget", "dette", "debt", "taux", "rate", "prix", "price",
    "production", "industrie", "financial", "economique",
]
PERMISSIVE_REJECT_PATTERNS = [
    r"[0-9]{4}$",
    r"(?:19|20)[0-9]{2}$",
    r"(?:table|tableau|total|sum)$",
    r"(?:source|note|reference)[:.]",
    r"html|css|javascript|script|div|span|class",
]
PERMISSIVE_TERMS = [
    "taux", "directeur", "monétaire", "banque", "centrale", "pib",
    "inflation", "population", "commerce", "export", "import",
    "croissance", "emploi", "statistique", "recensement",
    "gdp", "gross domestic product", "unemployment", "trade", "economy",
    "economic", "financial", "monetary", "fiscal", "development",
    "indicator", "index", "rate", "percentage", "billion", "million",
    "annual", "quarterly", "growth", "social", "demographic",
    "tunisia", "tunisian", "tn", "country", "national", "data",
    "value", "measure", "metric", "figure", "amount", "level",
    "current", "constant", "prices", "usd", "dollars",
]
YEAR_WORDS = ["year", "année", "date", "période"]
RATE_WORDS = ["taux", "rate", "%", "croissance"]
GDP_WORDS = ["pib", "gdp", "dette"]

# ---------------------------------------------------------------------------------------------
# Target catalogue
# ---------------------------------------------------------------------------------------------
TARGETS = {
    "comptes_nationaux": [
        "Produit Intérieur Brut (aux prix du marché)",
        "Revenu national",
        "Revenu national disponible brut",
        "Epargne nationale (brute)",
        "Epargne nationale (nette)",
        "PIB par habitant",
    ],
    "secteurs_institutionnels": [
        "Sociétés non financières",
        "Institutions financières",
        "Administration Publique",
        "Ménages",
        "Institutions sans but lucratif",
    ],
    "prix_et_inflation": [
        "Indice des prix à la consommation (IPC; 2015=100)",
        "Inflation",
        "Déflateur du PIB",
        "Indice des prix à la production",
    ],
    "menages": [
        "Revenu disponible brut des ménages",
        "Taille moyenne d'un ménage",
        "Dépenses de consommation finale",
        "Taux d'épargne des ménages",
    ],
    "commerce_exterieur": [
        "Exportations de biens",
        "Importations de biens",
        "Balance commerciale",
        "Taux de couverture",
    ],
    "finance_et_monnaie": [
        "Masse monétaire M3",
        "Crédits à l'économie",
        "Taux directeur BCT",
        "Réserves de change",
    ],
}
TARGET_KEYWORDS = [
    (["inflation", "prix", "ipc"], "prix_et_inflation"),
    (["pib", "revenu", "épargne", "national"], "comptes_nationaux"),
    (["export", "import", "balance", "commercial"], "commerce_exterieur"),
    (["ménage", "consommation", "dépense"], "menages"),
    (["monétaire", "crédit", "taux", "banque"], "finance_et_monnaie"),
    (["secteur", "institution", "administration"], "secteurs_institutionnels"),
]
TARGET_YEARS = list(range(PERIOD_START, PERIOD_END + 1))

# ---------------------------------------------------------------------------------------------
# Page and text topics
# ---------------------------------------------------------------------------------------------
TOPICS = {
    "monetary_financial": {
        "keywords": ["bct", "banque centrale", "taux directeur", "inflation", "monétaire", "crédit"],
        "indicators": ["taux", "inflation", "masse monétaire", "réserves"],
    },
    "statistical_demographic": {
        "keywords": ["ins", "statistique", "population", "démographie", "recensement", "enquête"],
        "indicators": ["population", "natalité", "mortalité", "migration"],
    },
    "industrial_production": {
        "keywords": ["industrie", "production", "manufacturier", "secteur", "usine"],
        "indicators": ["production", "capacité", "exportation", "emploi industriel"],
    },
    "trade_commerce": {
        "keywords": ["commerce", "export", "import", "échange", "balance"],
        "indicators": ["exportations", "importations", "balance commerciale", "partenaires"],
    },
    "employment_social": {
        "keywords": ["emploi", "chômage", "travail", "social", "salaire"],
        "indicators": ["taux chômage", "emploi", "salaires", "protection sociale"],
    },
}
PAGE_CLASSES_TEXT = [
    (["banque centrale", "bct", "monétaire", "taux directeur"], "monetary_financial"),
    (["ins", "statistique", "recensement", "démographie"], "statistical_demographic"),
    (["industrie", "production", "manufacturier", "secteur"], "industrial_production"),
    (["emploi", "chômage", "travail", "social", "salaire"], "employment_social"),
    (["commerce", "export", "import", "échange", "balance"], "trade_commerce"),
    (["actualité", "news", "communiqué", "presse"], "news_communication"),
]
PAGE_CLASSES_URL = [
    (["publication", "rapport", "document"], "publication_document"),
    (["api", "data", "json", "xml"], "api_data"),
]
PAGE_CLASS_DEFAULT = "general_economic"
CONTENT_ECONOMIC = ["banque centrale", "monétaire"]
CONTENT_STATISTICAL = ["statistique", "démographie"]
CONTENT_INDUSTRIAL = ["industrie", "production"]
NATIONAL_INSTITUTIONS = ["bct", "banque centrale tunisie", "ins", "institut national statistique"]
NATIONAL_PLACES = ["tunisie", "tunisia", "tunis", "sfax", "sousse", "gouvernorat"]
NATIONAL_TERMS = ["dinar", "tnd", "millimes", "pib tunisien", "économie tunisienne"]
DENSITY_INSTITUTIONS = ["bct", "ins", "ministère", "gouvernement"]
DENSITY_PLACES = ["tunisie", "tunis", "sfax", "sousse", "gouvernorat"]
DENSITY_TERMS = ["dinar", "économie tunisienne", "pib tunisien"]
SITE_CONTEXT = {
    "country_refs": ["tunisie", "tunisia", "tunisien", "tunisian"],
    "cities": ["tunis", "sfax", "sousse", "kairouan", "bizerte"],
    "institutions": ["bct", "ins", "gouvernement tunisien", "république tunisienne"],
    "currency": ["dinar", "tnd", "millimes"],
    "language": ["arabe", "arabic", "français", "french"],
}
CREDIBLE_INSTITUTIONS = ["officiel", "ministère", "banque centrale", "ins"]
CREDIBLE_METHOD = ["méthodologie", "enquête", "recensement", "étude"]
CREDIBLE_REFERENCE = ["source", "référence", "données"]
NATIONAL_KEYWORDS = [
    "tunisie", "tunisien", "bct", "ins", "dinar", "gouvernorat",
    "république tunisienne", "tunis", "sfax", "sousse",
]
INSTITUTIONS = [
    "BCT", "Banque Centrale de Tunisie", "INS", "Institut National de Statistique",
    "Ministère des Finances", "Ministère de l'Économie", "Gouvernement tunisien",
]
METHODOLOGY_TERMS = [
    "méthodologie", "enquête", "échantillon", "sondage", "recensement",
    "collecte", "traitement", "analyse statistique",
]
MONTHS = [
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet",
    "août", "septembre", "octobre", "novembre", "décembre",
]
RICHNESS_TERMS = [
    "statistique", "données", "indicateur", "tableau", "rapport",
    "publication", "chiffres", "analyse", "enquête", "résultats",
    "tunisie", "tunisien", "économie", "social", "démographie",
    "pib", "inflation", "emploi", "chômage", "commerce",
    "bct", "ins", "banque centrale", "institut statistique",
    "industrie", "export", "import", "finance", "monétaire",
]
RICHNESS_URL = ["stat", "données", "rapport", "publication", "indicateur", "économie", "pib", "emploi"]
RICHNESS_SPECIAL = ["inflation", "pib", "chômage", "exportation", "importation", "balance", "taux", "indice"]
RICHNESS_INSTITUTIONS = ["bct", "banque centrale", "ins", "institut national", "ministère", "gouvernement"]
INVENTORY_WORDS = [
    "PIB", "inflation", "chômage", "dette", "déficit", "export", "import", "taux", "cours",
    "indice", "population", "emploi", "salaire", "prix", "production",
]

# ---------------------------------------------------------------------------------------------
# Extraction patterns (the first group is the name, the second the value)
# ---------------------------------------------------------------------------------------------
TEXT_PATTERNS = [
    (r"(pib|gdp|produit intérieur brut)[:\s]*([0-9,.\s]+)\s*(milliards?|millions?|md|mdt)", True),
    (r"(taux de chômage|unemployment rate|chômage)[:\s]*([0-9,.\s]+)\s*%", False),
    (r"(inflation|taux d'inflation)[:\s]*([0-9,.\s]+)\s*%", False),
    (r"(population)[:\s]*([0-9,.\s]+)\s*(millions?|habitants?)", True),
    (r"(export(?:ation)?s?|import(?:ation)?s?)[:\s]*([0-9,.\s]+)\s*(milliards?|millions?|md|mdt|usd|eur)", True),
]
GOV_PATTERNS = [
    r"([0-9]+[.,][0-9]+)\s*%?\s*(?:taux|rate|pour cent)",
    r"(?:USD|EUR|Dollar|Euro)\s*[:\-=]?\s*([0-9]+[.,][0-9]+)",
    r"([0-9]+[.,][0-9]+)\s*(?:millions?|milliards?|MD|MMD)",
    r"(?:PIB|GDP)\s*[:\-=]?\s*([0-9]+[.,][0-9]+)",
    r"(?:population|habitants?)\s*[:\-=]?\s*([0-9]+[.,]?[0-9]*)",
    r"(?:inflation|déflation)\s*[:\-=]?\s*([0-9]+[.,][0-9]+)\s*%",
    r"(?:chômage|unemployment)\s*[:\-=]?\s*([0-9]+[.,][0-9]+)\s*%",
    r"(?:export|import|exportation|importation)\s*[:\-=]?\s*([0-9]+[.,]?[0-9]*)",
    r"(?:budget|recettes|dépenses)\s*[:\-=]?\s*([0-9]+[.,]?[0-9]*)",
    r"(?:déficit|excédent)\s*[:\-=]?\s*([0-9]+[.,][0-9]+)",
    r"\b([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]+)\b",
    r"\b([0-9]+[.,][0-9]+)\s*%\b",
    r">([0-9]+[.,]?[0-9]*)<",
    r'"([0-9]+[.,]?[0-9]*)"',
]
BANK_PATTERNS = [
    (r"(taux directeur|refinancement|intérêt)[:\s]*([0-9,\.]+)\s*%?", False),
    (r"(réserves?|masse monétaire|liquidité)[:\s]*([0-9\s,\.]+)\s*(md|millions?)?", True),
    (r"(change|euro|dollar)[:\s]*([0-9,\.]+)", False),
]
BANK_CAP = 15
FINANCE_PATTERNS = [
    (r"(budget|recettes|dépenses|déficit)[:\s]*([0-9\s,\.]+)\s*(md|millions?|milliards?)?", True),
    (r"(dette|pib)[:\s]*([0-9\s,\.]+)\s*(md|millions?)?", True),
    (r"(investissement|transfert)[:\s]*([0-9\s,\.]+)", False),
]
FINANCE_CAP = 20
BLOCK_PATTERNS = [
    (r"([A-Za-zÀ-ÿ\s]{5,40})[:=]\s*([0-9,\.]+)\s*(MD|%|millions?)?", True),
    (r"([A-Za-zÀ-ÿ\s]{5,40})\s*:\s*([0-9,\.]+)", False),
    (r"([A-Za-zÀ-ÿ\s]{5,40})\s*-\s*([0-9,\.]+)", False),
]
BLOCK_CAP = 5
BLOCKS_PER_PAGE = 5
GENERIC_PATTERNS = [
    (r'"value":\s*([0-9]+\.?[0-9]*(?:e[+-]?\d+)?)', 1),
    (r'"date":\s*"(\d{4})".*?"value":\s*([0-9]+\.?[0-9]*)', 2),
    (r"([A-Za-zÀ-ÿ\s\-_\.]{5,50})\s*[:=\-]\s*([0-9]+[,.]?[0-9]*)\s*(MD|MDT|%|millions?|milliards?|TND|USD|EUR)?", 3),
    (r'"([a-zA-Z_][a-zA-Z0-9_]*)":\s*([0-9]+\.?[0-9]*(?:e[+-]?\d+)?)', 2),
    (r"<t[dh][^>]*>([^<]{3,60})</t[dh]>\s*<t[dh][^>]*>([0-9,]+\.?[0-9]*[%]?)</t[dh]>", 2),
]
GENERIC_CAP = 15
LIST_PATTERNS = [
    r"^([^:]+):\s*([0-9,.\s%-]+)",
    r"^([^-]+)-\s*([0-9,.\s%-]+)",
    r"^([^=]+)=\s*([0-9,.\s%-]+)",
]
SITE_PATTERNS = {
    "statistical_institute": [
        r"indicateur.*\d+", r"statistique.*\d+", r"données.*\d+", r"taux.*\d+[.,]\d*",
        r"population.*\d+", r"emploi.*\d+", r"chômage.*\d+[.,]\d*",
    ],
    "central_bank": [
        r"taux.*change.*\d+", r"réserves.*\d+", r"balance.*\d+", r"crédit.*\d+[.,]\d*",
        r"inflation.*\d+[.,]\d*", r"tmm.*\d+[.,]\d*",
    ],
    "ministry_finance": [
        r"budget.*\d+", r"déficit.*\d+", r"recettes.*\d+", r"dépenses.*\d+[.,]\d*",
        r"dette.*\d+", r"pib.*\d+[.,]\d*",
    ],
}
# Each selector is (container tag or "", container class or "", inner tag or "").
SITE_SELECTORS = {
    "statistical_institute": [
        ("table", "data-table", "td"), ("", "statistique-value", ""), ("", "indicator-row", ""),
        ("", "tableau-statistique", "tr"), ("", "valeur-indicateur", ""), ("", "donnee-chiffree", ""),
    ],
    "central_bank": [
        ("table", "", "td"), ("", "tableau-statistique", "td"), ("", "indicator-cell", ""),
        ("", "valeur", ""), ("", "data-cell", ""),
    ],
    "ministry_finance": [
        ("", "financial-data", "td"), ("", "budget-table", "td"), ("", "economic-indicator", ""),
        ("", "valeur-budgetaire", ""), ("", "donnee-financiere", ""),
    ],
}
SELECTOR_CAP = 20
SCRIPT_URL_PATTERNS = [
    r"""url\s*:\s*["']([^"']*\.json)["']""",
    r"""ajax\s*:\s*["']([^"']*)["']""",
    r"""data-url=["']([^"']*)["']""",
    r"""api["']([^"']*)["']""",
]
SCRIPT_URL_CAP = 5
PROFILE_PATTERNS = [
    ("percentages", r"(\d+[,.]?\d*)\s*%"),
    ("millions_dinars", r"(\d+[,.]?\d*)\s*(?:MD|millions?\s*(?:de\s*)?dinars?)"),
    ("decimals", r"(\d+[,]\d+)"),
    ("large_numbers", r"(\d{1,3}(?:[\s.]\d{3})+)"),
    ("inflation_context", r"inflation.*?(\d+[,.]?\d*)"),
    ("chomage_context", r"chômage.*?(\d+[,.]?\d*)"),
    ("croissance_context", r"croissance.*?(\d+[,.]?\d*)"),
]
INVENTORY_NUMBER = r"\b\d{1,3}(?:[\s,]\d{3})*(?:[.,]\d+)?\s*(?:%|€|$|TND|MD|milliards?|millions?)\b"
TEXT_PAIR_PATTERN = r"([A-Za-zÀ-ÿ\s]+)[\s:]\s*([0-9,.-]+%?)"
NUMBER_TOKEN = r"([0-9]+[,.]?[0-9]*)"
FALLBACK_KEYWORDS = [
    "pib", "inflation", "chomage", "emploi", "population", "dette",
    "export", "import", "taux", "croissance", "production", "budget",
    "investissement", "reserves", "change", "credit", "epargne",
    "gdp", "unemployment", "growth", "rate", "trade", "balance",
    "deficit", "surplus", "revenue", "expenditure", "fiscal",
    "directeur", "monétaire", "commerciale", "extérieur", "publique",
]

# ---------------------------------------------------------------------------------------------
# HTML noise
# ---------------------------------------------------------------------------------------------
NOISE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
NOISE_CLASS_WORDS = ["nav", "menu", "header", "footer", "sidebar", "ad"]
NOISE_ID_WORDS = ["nav", "menu", "header"]

# ---------------------------------------------------------------------------------------------
# Priorities and labels of reports
# ---------------------------------------------------------------------------------------------
URGENT_WORDS = ["extracteur", "détecté", "LLM"]
IMPORTANT_WORDS = ["tableau", "parser", "format"]
