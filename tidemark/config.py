"""Rule rows, topics, code tables and areas. All of it is plain data."""
from __future__ import annotations

# --- fixed values: screening rules -------------------------------------------------
ROBUST_Z_THRESHOLD = 3.5
PRICE_DAILY = {"rule_id": "price_daily", "window": 250, "min_history": 60, "min_abs_pct": 4.0, "max_gap_days": 5, "last_n": 30}
PRICE_WEEKLY = {"rule_id": "price_weekly", "window": 156, "min_history": 52, "min_abs_pct": 3.0, "max_gap_days": 15, "last_n": 6}
PRICE_DAILY_MIN_PCT = {
    "eia.brent_spot": 4.0, "eia.wti_spot": 4.0, "derived.brent_eur_per_barrel": 4.0, "ecb.usd_per_eur": 1.0,
}
INVENTORY = {
    "years": 5, "week_halfwidth": 1, "min_history": 8, "max_gap_days": 8, "last_n": 8,
    "min_abs_change": {"thousand barrels": 4000.0, "percent": 2.0, "thousand barrels per day": 400.0},
}
SHIPPING = {
    "min_days_in_7d": 6, "low_quantile": 0.05, "high_quantile": 0.95, "min_abs_change": 5.0,
    "persistence_days": 2, "last_n": 21,
}
SHIPPING_BASELINE = {"start": "2025-01-01", "end": "2025-12-31"}
FUEL_LAG = {"window_weeks": 156, "lags": 3, "min_history": 60, "min_abs_eur_per_litre": 0.03, "last_n": 6}
THERMAL = {"quantile": 0.95, "min_baseline_days": 60, "routine_share_threshold": 0.8, "buffer_km": 5.0}
SUPPRESS_DAYS = 3

# --- fixed values: rule formulas ----------------------------------------------------
FORMULAS = {
    "price_daily": "price_daily/v1: log return to the previous observation, robust z against the previous window",
    "price_weekly": "price_weekly/v1: weekly log return, robust z against the previous window",
    "inventory_week": "inventory_week/v1: weekly change, robust z against the same ISO weeks of earlier years",
    "shipping_7d": "shipping_7d/v1: 7-day mean with at least 6 observed days against fixed-window quantiles",
    "fuel_lag_resid": "fuel_lag_resid/v1: distributed-lag residual, robust z against in-sample residuals",
}

# --- fixed values: arithmetic ---------------------------------------------------------
K_MAD = 0.67449
K_IQR = 1.349
LITRES_PER_BARREL = 158.987294928
GALLONS_PER_BARREL = 42.0
VAT_RATE = 0.19
TANK_LITRES = 50.0
CPI_1998_TO_2010 = 88.6 / 74.4
EARTH_RADIUS_KM = 6371.0088
HOUSEHOLD_SPEND = {"CP0722": 160.0, "CP0453": 60.0, "CP0451": 110.0, "CP0452": 90.0}
HOUSEHOLD_NAMES = {"CP0722": "Car fuel", "CP0453": "Heating oil", "CP0451": "Electricity", "CP0452": "Gas"}
GULF_CODES = ["SA", "IQ", "AE", "KW", "QA", "OM", "IR", "BH"]
AGGREGATE_CODES = ["TOTAL", "EU27_2020", "EU28", "EXT_EU27_2020", "EXT_EU28"]
MIN_MOVE_PCT = {"daily": 1.0, "weekly": 1.0, "monthly": 2.0}
STALE_DAYS = {"daily": 7, "weekly": 14, "monthly": 100}

# --- fixed values: event windows (days) -------------------------------------------------
WINDOWS = {
    "daily": {"before_days": 30, "after_days": 10},
    "weekly": {"before_days": 90, "after_days": 21},
    "monthly": {"before_days": 400, "after_days": 70},
    "event": {"before_days": 7, "after_days": 7},
}

# --- fixed values: claim words -----------------------------------------------------------
DIRECTION_WORDS = {
    "up": ["surge", "surges", "soar", "soars", "jump", "jumps", "spike", "spikes", "rise", "rises", "rising", "climb",
           "climbs", "record high", "rally", "steigen", "steigt", "gestiegen", "explodier", "Rekordhoch", "teurer",
           "Anstieg", "klettert", "schießen"],
    "down": ["plunge", "plunges", "fall", "falls", "falling", "drop", "drops", "slump", "slumps", "tumble", "decline",
             "cheaper", "sinken", "sinkt", "gesunken", "fallen", "fällt", "billiger", "Rückgang", "Einbruch",
             "bricht ein"],
    "disruption": ["disrupted", "disruption", "disrupts", "slows", "slowed", "closed", "closure", "blockade", "blocked",
                   "halt", "halted", "suspend", "suspended", "attack", "attacked", "seized", "gesperrt", "Sperrung",
                   "Störung", "gestört", "Blockade", "Angriff", "gestoppt"],
}

# --- fixed values: topics ------------------------------------------------------------------
TOPICS = {
    "hormuz_shipping": {
        "label": "Strait of Hormuz shipping", "geography": "Middle East",
        "keywords": ["hormuz", "hormus", "strait of hormuz", "straße von hormus", "persian gulf tanker", "gulf of oman",
                     "golf von oman", "tanker"],
        "require_any": [],
        "series": ["portwatch.hormuz.n_tanker", "portwatch.hormuz.n_total", "portwatch.hormuz.capacity_tanker",
                   "eia.brent_spot"],
        "alternatives": [
            "AIS coverage gaps or vessels switching off transponders change counted transits without changing real traffic",
            "Weekday and seasonal patterns in transit counts",
            "Vessels waiting at anchor raise occupancy without raising throughput",
            "Rerouting decisions by charterers/insurers rather than physical closure",
        ],
    },
    "red_sea_shipping": {
        "label": "Red Sea / Suez shipping", "geography": "Middle East / Africa",
        "keywords": ["red sea", "rotes meer", "suez", "bab el-mandeb", "houthi", "huthi", "cape of good hope",
                     "kap der guten hoffnung"],
        "require_any": [],
        "series": ["portwatch.bab_el_mandeb.n_total", "portwatch.suez.n_total", "portwatch.cape_good_hope.n_total",
                   "portwatch.bab_el_mandeb.n_tanker"],
        "alternatives": [
            "Rerouting via the Cape raises Cape counts and lowers Suez counts without a change in total trade",
            "AIS coverage limitations",
        ],
    },
    "crude_price": {
        "label": "Crude oil prices", "geography": "Global",
        "keywords": ["oil price", "oil prices", "brent", "crude", "wti", "ölpreis", "rohöl", "opec", "barrel"],
        "require_any": [],
        "series": ["eia.brent_spot", "eia.wti_spot", "derived.brent_eur_per_barrel", "ecb.usd_per_eur"],
        "alternatives": [
            "General risk sentiment and financial-market moves unrelated to physical supply",
            "US dollar movements (Brent in euros may move differently)",
            "OPEC+ production decisions",
            "Demand outlook revisions (China, global growth)",
        ],
    },
    "german_fuel_prices": {
        "label": "German / EU retail fuel prices", "geography": "Germany / EU",
        "keywords": ["diesel", "benzin", "super e10", "spritpreis", "spritpreise", "kraftstoff", "tankstelle",
                     "petrol price", "fuel price", "heizöl", "heating oil", "gasoline", "petrol"],
        "require_any": [],
        "series": ["oil_bulletin.DE.diesel.with_tax", "oil_bulletin.DE.diesel.without_tax",
                   "oil_bulletin.DE.euro95.with_tax", "oil_bulletin.DE.euro95.without_tax",
                   "oil_bulletin.EU.diesel.with_tax", "derived.brent_eur_per_litre"],
        "alternatives": [
            "Tax changes (energy tax, CO2 price, VAT) shift gross prices without a market change",
            "Exchange-rate moves change euro crude cost",
            "Refining margins for diesel/gasoline can move independently of crude",
            "Weekly bulletin prices are Monday snapshots and lag crude moves",
        ],
    },
    "us_inventories": {
        "label": "US oil inventories", "geography": "US",
        "keywords": ["inventories", "stockpile", "crude stocks", "eia report", "lagerbestände",
                     "strategic petroleum reserve", "spr", "distillate"],
        "require_any": [],
        "series": ["eia.us_commercial_crude_stocks", "eia.us_spr_stocks", "eia.us_distillate_stocks",
                   "eia.us_gasoline_stocks", "eia.us_refinery_utilisation"],
        "alternatives": [
            "Seasonal stock build/draw patterns",
            "Import/export timing shifts between weeks",
            "SPR releases are policy decisions, separate from commercial stocks",
        ],
    },
    "refinery_disruption": {
        "label": "Refinery disruption", "geography": "facility-specific", "satellite": True,
        "keywords": ["refinery", "raffinerie", "refining", "fire", "explosion", "drone", "outage", "brand", "ras tanura",
                     "abadan", "bandar abbas", "schwedt", "pck", "leuna", "miro"],
        "require_any": ["refinery", "refineries", "raffinerie", "refining", "ras tanura", "abadan", "bandar abbas",
                        "schwedt", "pck", "leuna", "miro", "oil terminal", "ölterminal"],
        "series": ["eia.us_refinery_utilisation", "eia.us_distillate_stocks", "oil_bulletin.DE.diesel.without_tax"],
        "alternatives": [
            "Routine gas flaring produces persistent heat detections",
            "Planned maintenance turnarounds",
            "Fires unrelated to attacks (industrial accidents)",
            "Clouds/smoke obscure optical imagery — absence of visible damage is not evidence of no damage",
        ],
    },
    "jodi_supply": {
        "label": "National oil production / trade (JODI)", "geography": "Global",
        "keywords": ["production", "förderung", "exports", "imports", "output", "saudi", "iraq", "iran", "uae", "kuwait"],
        "require_any": ["oil", "öl", "ölförder", "erdöl", "rohöl", "crude", "opec", "barrel", "petroleum"],
        "series": [],
        "alternatives": [
            "JODI country coverage changes month to month; balanced samples only",
            "Late or revised national submissions",
        ],
    },
}

# --- fixed values: facilities with the names that mention them ------------------------------
FACILITY_ALIASES = {
    "ras_tanura": ["Ras Tanura", "Ras Tannura"], "abadan": ["Abadan"],
    "bandar_abbas_pgsc": ["Bandar Abbas", "Persian Gulf Star"], "ruwais": ["Ruwais"],
    "pck_schwedt": ["Schwedt", "PCK"], "miro_karlsruhe": ["MiRO", "Karlsruhe refinery"], "leuna": ["Leuna"],
}

# --- fixed values: title stop words -----------------------------------------------------------
STOP_WORDS = (
    "the a an of to in on for and or at by with from is are was were be as its it this that über und der die das ein "
    "eine im in von zu mit auf für bei nach"
).split()

# --- fixed values: tracking parameters dropped from addresses -----------------------------------
TRACKING_PATTERN = "(?i)^(utm_|fbclid|gclid|mc_|ocid|cmpid|at_|xtor|wt_|ref$|sara_)"

# --- fixed values: conclusive wording that a note must not use ------------------------------------
CAUSAL_PATTERNS = [
    r"\bbecause\b", r"\bcaused?\b", r"\bdue to\b", r"\bled to\b", r"\bresult(ed|s)? (in|from)\b", r"\bdrove\b",
    r"\bdriven by\b", r"\btriggered\b", r"\bproves?\b", r"\bconfirms?\b", r"\bwegen\b", r"\bverursacht",
    r"\bführte zu\b", r"\bbeweist\b", r"\bdestroyed\b", r"\bzerstört",
]
NUMBER_PATTERN = "[-+\u2212]?\\d[\\d,.\u202f ]*\\d|[-+\u2212]?\\d"

# --- fixed values: vessel tables ------------------------------------------------------------------
NAV_STATUS = {
    0: "under way using engine", 1: "at anchor", 2: "not under command", 3: "restricted manoeuvrability",
    4: "constrained by draught", 5: "moored", 6: "aground", 7: "engaged in fishing", 8: "under way sailing",
    14: "AIS-SART active", 15: "not defined",
}
SHIP_TYPE_NAMES = {
    30: "fishing", 31: "towing", 32: "towing (large)", 33: "dredging/underwater ops", 34: "diving ops",
    35: "military ops", 36: "sailing", 37: "pleasure craft", 50: "pilot vessel", 51: "search and rescue", 52: "tug",
    53: "port tender", 54: "anti-pollution", 55: "law enforcement", 58: "medical transport",
}
SHIP_TYPE_DECADES = {2: "wing in ground", 4: "high-speed craft", 6: "passenger", 7: "cargo", 8: "tanker", 9: "other type"}
HAZARD_SUFFIX = {1: ", hazard cat. A", 2: ", hazard cat. B", 3: ", hazard cat. C", 4: ", hazard cat. D"}
SERVICE_TYPES = [31, 32, 33, 34, 50, 51, 52, 53, 54, 55, 58, 59]
# First three digits of a vessel number, per flag state.
FLAG_DIGITS = {
    "Panama": [351, 352, 353, 354, 355, 356, 357, 370, 371, 372, 373, 374], "Liberia": [636, 637],
    "Marshall Islands": [538], "Malta": [215, 229, 248, 249, 256], "Bahamas": [308, 309, 311],
    "Greece": [237, 239, 240, 241], "Singapore": [563, 564, 565, 566], "Hong Kong": [477], "China": [412, 413, 414],
    "Cyprus": [209, 210, 212], "Norway": [257, 258, 259], "United Kingdom": [232, 233, 234, 235],
    "Germany": [211, 218], "Netherlands": [244, 245, 246], "Denmark": [219, 220], "Italy": [247],
    "France": [226, 227, 228], "Spain": [224, 225], "Türkiye": [271], "Saudi Arabia": [403],
    "United Arab Emirates": [470, 471], "Iran": [422], "Iraq": [425], "Kuwait": [447], "Qatar": [466], "Oman": [461],
    "Bahrain": [408], "India": [419], "Japan": [431, 432], "South Korea": [440, 441],
    "United States": [303, 338, 366, 367, 368, 369], "Russia": [273], "Egypt": [622], "Antigua and Barbuda": [304, 305],
    "Portugal (Madeira)": [255], "Belgium": [205], "Sweden": [265, 266], "Finland": [230], "Indonesia": [525],
    "Malaysia": [533], "Vietnam": [574], "Philippines": [548], "Comoros": [616, 620], "Togo": [671], "Cameroon": [613],
    "Gabon": [626], "Sierra Leone": [667], "Tanzania": [674, 677], "Palau": [511], "Tuvalu": [572],
    "Cook Islands": [518], "St Kitts and Nevis": [341], "St Vincent and the Grenadines": [375, 376, 377],
    "Belize": [312], "Barbados": [314], "Jamaica": [339], "Honduras": [334], "Mongolia": [457], "Sri Lanka": [417],
    "Pakistan": [463], "Yemen": [473, 475], "Djibouti": [621], "Eritrea": [625], "Sudan": [662], "Jordan": [438],
    "Israel": [428], "Lebanon": [450], "Syria": [468], "Libya": [642], "Algeria": [605], "Morocco": [242],
    "Tunisia": [672], "Nigeria": [657], "Brazil": [710], "Canada": [316], "Mexico": [345], "Australia": [503],
    "New Zealand": [512], "Poland": [261], "Portugal": [263], "Ireland": [250], "Estonia": [276], "Latvia": [275],
    "Lithuania": [277], "Croatia": [238], "Bulgaria": [207], "Romania": [264], "Ukraine": [272],
}
# Corner boxes: (lat_min, lon_min, lat_max, lon_max).
AREAS = {
    "gulf": (22.0, 47.5, 30.5, 60.5), "red_sea": (10.5, 32.0, 30.0, 52.0), "suez_med": (30.0, 25.0, 37.5, 36.5),
    "north_sea": (49.0, -6.0, 58.5, 10.5), "baltic": (53.5, 9.5, 66.0, 30.5), "malacca": (-1.0, 95.0, 8.0, 105.5),
    "world": (-90.0, -180.0, 90.0, 180.0),
}

# --- fixed values: price workbooks ------------------------------------------------------------------
COUNTRY_CODES = {
    "austria": "AT", "belgium": "BE", "bulgaria": "BG", "croatia": "HR", "cyprus": "CY", "czechia": "CZ",
    "czech republic": "CZ", "denmark": "DK", "estonia": "EE", "finland": "FI", "france": "FR", "germany": "DE",
    "greece": "GR", "hungary": "HU", "ireland": "IE", "italy": "IT", "latvia": "LV", "lithuania": "LT",
    "luxembourg": "LU", "malta": "MT", "netherlands": "NL", "poland": "PL", "portugal": "PT", "romania": "RO",
    "slovakia": "SK", "slovenia": "SI", "spain": "ES", "sweden": "SE",
}
EU_ALIASES = ["EU", "EUR", "EU27", "EU_27"]
PRODUCT_PATTERNS = {
    "euro95": r"(?i)euro[\s-]*super\s*95|euro95",
    "diesel": r"(?i)automotive\s+gas\s*oil|gas\s*oil\s+automobile|dieselkraftstoff|\bdiesel\b",
    "heating_oil": r"(?i)heating\s+gas\s*oil|gas\s*oil\s+de\s+chauffage|heiz[öo]l|heating_oil",
}
UNIT_PER_1000L = r"(?i)(1\s*000|1\.000|1,000|1000)\s*(l\b|litres?|liters?|ltr)"
UNIT_PER_L = r"(?i)(€|eur|euro)s?\s*(/|per)\s*(l\b|litre|liter)"
PLAUSIBLE_PER_1000L = (300.0, 5000.0)
PLAUSIBLE_PER_L = (0.2, 5.0)
PROVIDER_UNITS = {
    "USD per barrel": ["$/BBL"], "USD per gallon": ["$/GAL"], "thousand barrels": ["MBBL"],
    "thousand barrels per day": ["MBBL/D"], "percent": ["%", "PERCENT"],
}
UNIT_NAMES = {"KBD": "thousand barrels per day", "KBBL": "thousand barrels"}
PROVIDER_ASSESSMENT = {"1": "comparable", "2": "consult metadata", "3": "not assessed"}

# --- fixed values: imagery classes -------------------------------------------------------------------
USABLE_CLASSES = [2, 4, 5, 6, 7]
NBR_DROP = 0.27
PIXEL_AREA_M2 = 400
CANDIDATE_MIN_PX, CANDIDATE_MAX_PX = 3, 3000
FIXED_STRUCTURE_M, DEDUPE_M, MIN_WATER = 250.0, 100.0, 0.8
