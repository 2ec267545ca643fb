"""Rule vocabularies of the catalogue.

Fixed values: the lists below must equal the catalogue's own for equal results. In a rule the first element is the
canonical value and the rest are its terms; the order of rules is their priority.
"""

from __future__ import annotations

NORMALIZATION_VERSION = "2026-10-05"

PRODUCT_TYPES = ["abbigliamento", "scarpe", "accessori", "altro"]

MARKETING_PHRASES = ["spedizione gratuita", "spedizione gratis", "best seller", "best-seller", "garanzia italia", "in offerta", "promo", "promozione", "offerta", "sconto", "gratis", "novita"]

CATEGORY_RULES = [
    ("scarpe", "air jordan", "jordan", "sneakers", "sneaker", "stivali", "sandali", "mocassini", "loafer", "ciabatte", "scarpa", "footwear"),
    ("accessori", "borsa", "zaino", "cappello", "berretto", "cintura", "portafoglio", "occhiali", "sciarpa", "guanti", "gioiello", "orecchini", "collana", "bracciale", "accessory", "accessories"),
    ("abbigliamento", "apparel", "clothing", "felpa", "t-shirt", "t shirt", "maglietta", "pantaloni", "jeans", "giacca", "cappotto", "camicia", "abito", "gonna", "shorts", "pantaloncini", "maglione", "cardigan", "polo", "body", "leggings", "top", "tuta", "costume", "intimo", "calze", "pigiama"),
]

SUBCATEGORY_RULES = [
    ("sneakers", "air jordan", "jordan"),
    ("felpe", "felpa", "hoodie", "sweatshirt"),
    ("magliette", "t-shirt", "t shirt", "maglietta", "tee"),
    ("top", "top", "canotta", "tank top", "crop top"),
    ("polo", "polo"),
    ("pantaloni", "pantaloni", "trousers", "jogger", "chino"),
    ("jeans", "jeans"),
    ("leggings", "leggings", "legging"),
    ("giacche", "giacca", "jacket", "bomber", "blazer"),
    ("cappotti", "cappotto", "coat", "piumino", "parka"),
    ("camicie", "camicia", "shirt", "blusa"),
    ("abiti", "abito", "dress", "vestito"),
    ("gonne", "gonna", "skirt"),
    ("pantaloncini", "shorts", "pantaloncini"),
    ("tute", "tuta", "tracksuit", "jumpsuit"),
    ("costumi", "costume", "swimwear", "bikini"),
    ("intimo", "intimo", "lingerie", "bra", "slip", "brief"),
    ("calze", "calze", "socks"),
    ("pigiami", "pigiama", "pyjama"),
    ("sneakers", "sneaker", "sneakers"),
    ("stivali", "stivali", "stivale", "boots", "boot"),
    ("sandali", "sandali", "sandalo", "sandals"),
    ("scarpe", "scarpe", "scarpa", "loafer", "mocassini", "ciabatte"),
    ("borse", "borsa", "bag"),
    ("zaini", "zaino", "backpack"),
    ("cappelli", "cappello", "berretto", "cap", "beanie"),
    ("cinture", "cintura", "belt"),
    ("portafogli", "portafoglio", "wallet"),
    ("occhiali", "occhiali", "glasses", "sunglasses"),
    ("gioielli", "gioiello", "jewellery", "jewelry", "orecchini", "collana", "bracciale", "anello"),
]

#: Product type of a subcategory; any other subcategory is clothing.
SUBCATEGORY_TYPES = {
    "sneakers": "scarpe",
    "stivali": "scarpe",
    "sandali": "scarpe",
    "scarpe": "scarpe",
    "borse": "accessori",
    "zaini": "accessori",
    "cappelli": "accessori",
    "cinture": "accessori",
    "portafogli": "accessori",
    "occhiali": "accessori",
    "gioielli": "accessori",
}

COLOR_RULES = [
    ("nero", "nero", "nera", "neri", "nere", "black"),
    ("bianco", "bianco", "bianca", "bianchi", "bianche", "white"),
    ("grigio", "grigio", "grigia", "grigi", "grigie", "grey", "gray"),
    ("blu", "blu", "blue", "navy"),
    ("rosso", "rosso", "rossa", "rossi", "rosse", "red"),
    ("verde", "verde", "verdi", "green", "militare", "army"),
    ("giallo", "giallo", "gialla", "gialli", "gialle", "yellow"),
    ("rosa", "rosa", "pink"),
    ("viola", "viola", "purple"),
    ("arancione", "arancione", "orange"),
    ("marrone", "marrone", "brown"),
    ("beige", "beige", "cream", "panna", "avorio", "ivory", "ecru", "camel", "sabbia", "sand", "taupe"),
    ("multicolore", "multicolore", "multicolor", "multi colour"),
]

MATERIAL_RULES = [
    ("cotone", "cotone", "cotton"),
    ("lana", "lana", "wool"),
    ("pelle", "pelle", "leather"),
    ("denim", "denim"),
    ("lino", "lino", "linen"),
    ("seta", "seta", "silk"),
    ("poliestere", "poliestere", "polyester"),
    ("nylon", "nylon"),
    ("viscosa", "viscosa", "viscose"),
    ("poliammide", "poliammide", "polyamide"),
    ("elastan", "elastan", "elastane", "spandex"),
    ("cashmere", "cashmere", "cashmere"),
]

GENDER_RULES = [
    ("donna", "donna", "women", "woman", "female", "ladies"),
    ("uomo", "uomo", "men", "man", "male", "mens"),
    ("bambino", "kids", "kid", "bambino", "bambina", "junior", "boys", "girls"),
    ("unisex", "unisex"),
]

AGE_GROUP_RULES = [
    ("adulto", "adult", "adults", "adulto", "adulta"),
    ("bambino", "kids", "kid", "bambino", "bambina", "junior", "boys", "girls"),
]

#: Words that describe a material and are left out of displayed titles only.
DISPLAY_ONLY_WORDS = ["tessuto", "intrecciato", "intrecciata", "maglia", "mesh", "suede", "scamosciato", "scamosciata", "sintetico", "sintetica", "tecnico", "tecnica", "riciclato", "riciclata", "impermeabile", "trapuntato", "trapuntata", "jersey", "canvas", "rafia", "crochet"]

NULL_BRANDS = ["n/a", "na", "null", "none", "unknown", "no brand", "brandless", "generico"]
NULL_MPNS = ["n/a", "na", "null", "none", "-", "0"]
UNAVAILABLE_VALUES = ["0", "false", "no", "out of stock", "out_of_stock", "outofstock", "unavailable", "sold out"]

UNITS = ["gb", "tb", "mb", "ram", "mah", "kg", "g", "cm", "mm", "pollici", "inch"]

#: Last words that mark an unfinished title, and further words that belong to attribute columns.
TITLE_TRAILING_WORDS = ["in", "di", "da", "con", "per", "e", "ed", "o", "and", "or", "with", "for", "made"]
TITLE_ATTRIBUTE_WORDS = ["militare", "tessuto", "intrecciato", "intrecciata", "mesh", "suede", "scamosciato", "scamosciata"]

#: Sizes. Letters; numbered ones up to which "2xl" goes; numbers that are sizes on their own; regions with their first and
#: last number, and those that write a leading zero; words for the one size there is; labels before a size in a text.
SIZE_LETTERS = ["xxs", "xs", "s", "m", "l", "xl", "xxl", "xxxl"]
SIZE_LARGEST_XL = 6
SIZE_NUMBERS = (30, 59)
SIZE_REGIONS = {"it": (0, 59), "eu": (0, 59), "uk": (3, 15), "us": (3, 15)}
SIZE_ZERO_REGIONS = ["it", "eu"]
SIZE_WORDS = ["taglia unica", "one size", "uni"]
SIZE_ONE_WORDS = ["taglia unica", "one size", "onesize"]
SIZE_ONE_ALIASES = ["one size", "onesize", "tu", "uni"]
SIZE_LABELS = ["taglia", "size", "misura"]

#: Spellings of feeds that are put right in titles.
SPELLINGS = {"pantaloni jean": "Pantaloni Jeans"}

#: Words that link two parts of a title: before an attribute, before a conjunction, and conjunctions.
TITLE_LINKS = ["in", "di", "da", "con", "per"]
TITLE_CONNECTORS = ["in", "di", "da", "con", "per", "for", "with", "made"]
TITLE_PAIR_CONJUNCTIONS = ["e", "ed", "and", "a"]
TITLE_CONJUNCTIONS = ["e", "ed", "and", "o", "or"]

FAMILY_COLORS = ["nero", "bianco", "blu", "rosso", "verde", "grigio", "beige", "rosa", "marrone", "giallo", "viola"]

VISUAL_COLOR_ALIASES = {
    "white": "bianco",
    "black": "nero",
    "blue": "blu",
    "red": "rosso",
    "green": "verde",
    "yellow": "giallo",
    "pink": "rosa",
    "purple": "viola",
    "orange": "arancione",
    "brown": "marrone",
    "grey": "grigio",
    "gray": "grigio",
    "cream": "beige",
    "ivory": "beige",
    "gold": "oro",
    "silver": "argento",
}
VISUAL_COLORS = ["bianco", "nero", "blu", "rosso", "verde", "giallo", "rosa", "viola", "arancione", "marrone", "grigio", "beige", "oro", "argento", "multicolore"]

QUERY_AGE_GROUPS = {"adulti": "adulto", "adulto": "adulto", "adult": "adulto", "kids": "bambino", "kid": "bambino", "infant": "bambino", "bambino": "bambino", "bambini": "bambino"}

RANKING_STOP_WORDS = ["a", "al", "con", "da", "del", "di", "e", "in", "il", "la", "o", "per", "un", "una"]

HISTORY_KEYS = ["age_group", "brand", "color", "color_logic", "condizione", "excluded_color", "excluded_material", "excluded_product_type", "gender", "in_stock_only", "material", "material_logic", "max_price", "merchant", "min_price", "only_on_sale", "product_type", "size", "sottocategoria", "sort_by"]

LETTER_SIZES = ["XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL"]

CURRENCY_SIGNS = {"EUR": "€", "GBP": "£", "USD": "$"}

#: Feed headers of each field, in the order in which the first filled one wins.
HEADERS = {
    "advertiser": ["advertiser_id", "merchant_id"],
    "source_id": ["id", "merchant_product_id", "product_id"],
    "title": ["title", "product_name", "name"],
    "merchant_link": ["link", "merchant_deep_link", "product_url"],
    "affiliate_link": ["aw_deep_link"],
    "price": ["price", "search_price", "store_price"],
    "sale_price": ["sale_price"],
    "description": ["description", "product_description", "product_detail"],
    "category": ["product_type", "google_product_category", "merchant_category"],
    "brand": ["brand", "brand_name"],
    "color": ["color", "colour"],
    "material": ["material", "fabric", "fashion:material"],
    "gender": ["gender", "sex"],
    "age_group": ["age_group"],
    "size": ["size", "sizes", "available_sizes", "taglia", "fashion:size"],
    "model": ["mpn", "model", "manufacturer_part_number"],
    "ean": ["gtin", "ean"],
    "merchant_name": ["advertiser_name", "merchant_name"],
    "image": ["image_link", "aw_image_url", "merchant_image_url"],
    "currency": ["currency"],
}
