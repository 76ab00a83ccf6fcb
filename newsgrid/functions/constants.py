"""Coding tables, name lists and thresholds that results depend on."""

# Fixed values. Root code: (token, label, verb, preposition before the second actor; empty: direct object).
ROOTS = {
    "01": ("STATEMENT", "Public statement", "makes a public statement", "about"),
    "02": ("APPEAL", "Appeal", "appeals", "to"),
    "03": ("INTENT", "Intent to cooperate", "expresses intent to cooperate", "with"),
    "04": ("CONSULT", "Consultation", "consults", "with"),
    "05": ("DIPLOMACY", "Diplomatic cooperation", "cooperates diplomatically", "with"),
    "06": ("COOPERATE", "Material cooperation", "cooperates materially", "with"),
    "07": ("AID", "Aid", "provides aid", "to"),
    "08": ("YIELD", "Yield", "yields", "to"),
    "09": ("INVESTIGATE", "Investigation", "investigates", ""),
    "10": ("DEMAND", "Demand", "makes demands", "of"),
    "11": ("DISAPPROVE", "Disapproval", "criticizes", ""),
    "12": ("REJECT", "Rejection", "rejects", ""),
    "13": ("THREATEN", "Threat", "threatens", ""),
    "14": ("PROTEST", "Protest", "protests", "against"),
    "15": ("FORCE", "Show of force", "exhibits force", "toward"),
    "16": ("REDUCE", "Reduced relations", "reduces relations", "with"),
    "17": ("COERCE", "Coercion", "coerces", ""),
    "18": ("ASSAULT", "Assault", "assaults", ""),
    "19": ("FIGHT", "Fighting", "fights", ""),
    "20": ("MASSVIOLENCE", "Mass violence", "uses mass violence", "against"),
}
DEFAULT_ROOT = ("EVENT", "Other event", "interacts", "with")
UNKNOWN_ACTOR = "Unidentified actor"

# Fixed values. Daily histogram label of a root code; all others: other.
DAILY_TYPES = {
    "01": "statement",
    "02": "appeal",
    "03": "intent",
    "04": "consult",
    "05": "consult",
    "06": "material",
    "07": "aid",
    "08": "aid",
    "09": "yield",
    "10": "demand",
    "11": "disapprove",
    "12": "reject",
    "13": "threaten",
    "14": "protest",
    "15": "force",
    "16": "coerce",
    "17": "coerce",
    "18": "fight",
    "19": "fight",
    "20": "fight",
}

# Fixed values. First-level divisions as damaged in the source, and their names.
DAMAGED_DIVISIONS = {
    "Méco": "Estado de México",
    "Nuevo LeóX": "Nuevo León",
    "Queréro de Arteaga": "Querétaro de Arteaga",
    "YucatáMX": "Yucatán",
    "Michoacáde Ocampo": "Michoacán de Ocampo",
    "San Luis PotosíX": "San Luis Potosí",
}

# Fixed values. Actor names written otherwise.
ACTOR_ALIASES = {
    "U.S.": "UNITED STATES",
    "US": "UNITED STATES",
    "USA": "UNITED STATES",
    "U.S.A.": "UNITED STATES",
    "AMERICA": "UNITED STATES",
    "UNITED STATES OF AMERICA": "UNITED STATES",
    "CAN": "CANADA",
    "CA": "CANADA",
    "MEX": "MEXICO",
    "MX": "MEXICO",
}

# Fixed values. Three-letter codes of actors' countries.
ACTOR_COUNTRIES = {
    "CA": "CAN",
    "CANADA": "CAN",
    "CAN": "CAN",
    "US": "USA",
    "U.S.": "USA",
    "USA": "USA",
    "U.S.A.": "USA",
    "UNITED STATES": "USA",
    "UNITED STATES OF AMERICA": "USA",
    "AMERICA": "USA",
    "MX": "MEX",
    "MEX": "MEX",
    "MEXICO": "MEX",
}

# Fixed values. Words of a request that say nothing about its topic.
FILLER_WORDS = [
    "find", "search", "show", "list", "give", "get", "tell", "look", "looking", "want",
    "news", "article", "articles", "story", "stories", "report", "reports", "coverage",
    "headline", "headlines", "mentioning", "mention", "mentions", "about", "regarding",
    "event", "events", "the", "and", "for", "with", "from", "that", "this", "any", "all",
    "what", "which", "were", "was", "are", "has", "have", "had", "did", "does", "of",
]

# Fixed values. Geocoded names that are no places, and words of such names.
NOT_PLACES = [
    "World Bank", "Blackrock", "Department Of Education", "Columbia University", "Trump Tower",
    "Miguel Angel", "Capitol Hill", "White House", "The White House", "Hollywood", "Times Square",
    "Stanford", "Long Island",
]
NOT_PLACE_WORDS = ["University", "Department", "Bank", "Tower", "Hospital", "Airport", "College"]

#: Goldstein score of a conflict (below the negative) or a cooperation (above): in search, and in daily counts.
SEARCH_BAR, DAILY_BAR = 5, 0
PROTEST_ROOT = "14"
#: Change of a daily rate, in percent, that counts as flat; events below which no direction is called.
FLAT_PERCENT, LOW_VOLUME = 5.0, 30

# Names by which a region is also known.
REGION_ALIASES = {
    "Washington": ["DC"],
    "New York": ["NYC"],
    "Los Angeles": ["LA"],
    "San Francisco": ["SF"],
    "SF": ["San Francisco"],
    "NYC": ["New York"],
    "LA": ["Los Angeles"],
    "DC": ["Washington"],
    "San Diego": ["SD"],
    "Europe": ["European"],
    "Asia": ["Asian"],
    "Illinois": ["IL"],
    "Ohio": ["OH"],
    "Georgia": ["GA"],
    "New Jersey": ["NJ"],
    "Utah": ["UT"],
    "Oregon": ["OR"],
}
# Postal codes of first-level divisions.
STATE_CODES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
    "DC": "District of Columbia",
}
# What a stated number of records may be written as.
COUNT_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
# Labels of event codes.
CODE_LABELS = {
    "010": "Make statement",
    "011": "Decline comment",
    "012": "Make pessimistic comment",
    "013": "Make optimistic comment",
    "014": "Consider policy option",
    "015": "Engage in material cooperation",
    "016": "Engage in diplomatic cooperation",
    "017": "Engage in material conflict",
    "018": "Engage in diplomatic conflict",
    "019": "Make public statement",
    "020": "Yield",
    "021": "Ease administrative sanctions",
    "022": "Ease military blockade",
    "023": "Accede to demands for change in leadership",
    "024": "Return, release",
    "025": "Ease military alert",
    "026": "Ease political dissent",
    "027": "Yield",
    "028": "Yield",
    "030": "Disapprove",
    "031": "Criticize or denounce",
    "032": "Accuse",
    "033": "Rally opposition",
    "034": "Complain officially",
    "035": "Bring lawsuit against",
    "036": "Investigate",
    "037": "Threaten",
    "038": "Reject",
    "039": "Threaten",
    "040": "Reject",
    "041": "Reject accusation",
    "042": "Reject proposal to meet, discuss, or negotiate",
    "043": "Reject plan, agreement to settle dispute",
    "044": "Reject request for military aid",
    "045": "Reject request for economic aid",
    "046": "Reject request for humanitarian aid",
    "047": "Reject request for military protection",
    "048": "Reject request for change in leadership",
    "049": "Reject request for change in policy",
    "050": "Threaten",
    "051": "Threaten non-force",
    "052": "Threaten with administrative sanctions",
    "053": "Threaten with political dissent",
    "054": "Threaten to halt negotiations",
    "055": "Threaten to halt mediation",
    "056": "Threaten to impose blockade, restrict movement",
    "057": "Threaten with military force",
    "058": "Threaten to use unconventional mass violence",
    "060": "Protest",
    "061": "Demonstrate or rally",
    "062": "Conduct hunger strike",
    "063": "Conduct strike or boycott",
    "064": "Obstruct passage, block",
    "065": "Protest violently, riot",
    "066": "Engage in violent protest",
    "067": "Engage in political dissent",
    "068": "Engage in violent protest",
    "070": "Coerce",
    "071": "Seize or damage property",
    "072": "Impose administrative sanctions",
    "073": "Impose military blockade",
    "074": "Arrest or detain",
    "075": "Use force to restore order",
    "076": "Impose state of emergency or martial law",
    "077": "Violate ceasefire",
    "078": "Escalate military engagement",
    "080": "Assault",
    "081": "Assault with weapons",
    "082": "Sexually assault",
    "083": "Kill by physical assault",
    "084": "Kill",
    "085": "Use unconventional mass violence",
    "086": "Use biological weapons",
    "087": "Use chemical weapons",
    "088": "Use radiological weapons",
    "090": "Use force",
    "091": "Use military force",
    "092": "Employ aerial weapons",
    "093": "Employ artillery and tanks",
    "094": "Use small arms and light weapons",
    "095": "Use conventional military force",
    "096": "Use unconventional mass violence",
    "097": "Use biological weapons",
    "098": "Use radiological weapons",
    "100": "Use chemical weapons",
    "101": "Use biological weapons",
    "102": "Use radiological weapons",
    "103": "Use nuclear weapons",
    "104": "Use force",
    "105": "Use force",
    "106": "Use force",
    "107": "Use force",
    "108": "Use force",
    "110": "Demonstrate force",
    "111": "Demonstrate military force",
    "112": "Demonstrate crowd control",
    "113": "Demonstrate riot control",
    "114": "Demonstrate military force",
    "115": "Demonstrate military force",
    "116": "Demonstrate military force",
    "120": "Use force",
    "121": "Use force",
    "122": "Use force",
    "123": "Use force",
    "124": "Use unconventional mass violence",
    "125": "Use biological weapons",
    "126": "Use chemical weapons",
    "127": "Use radiological weapons",
    "128": "Use nuclear weapons",
    "129": "Use force",
    "130": "Threaten",
    "131": "Threaten",
    "132": "Threaten",
    "133": "Threaten",
    "134": "Threaten",
    "135": "Threaten",
    "136": "Threaten",
    "137": "Threaten",
    "138": "Threaten",
    "139": "Threaten",
    "140": "Coerce",
    "141": "Coerce",
    "142": "Coerce",
    "143": "Coerce",
    "144": "Coerce",
    "145": "Coerce",
    "146": "Coerce",
    "150": "Engage in material cooperation",
    "151": "Engage in economic cooperation",
    "152": "Engage in military cooperation",
    "153": "Engage in judicial cooperation",
    "154": "Engage in intelligence cooperation",
    "155": "Engage in diplomatic cooperation",
    "160": "Engage in diplomatic cooperation",
    "161": "Engage in diplomatic cooperation",
    "162": "Engage in diplomatic cooperation",
    "163": "Engage in diplomatic cooperation",
    "164": "Engage in diplomatic cooperation",
    "165": "Engage in diplomatic cooperation",
    "166": "Engage in diplomatic cooperation",
    "170": "Yield",
    "171": "Ease administrative sanctions",
    "172": "Ease military blockade",
    "173": "Accede to demands for change in leadership",
    "174": "Return, release",
    "175": "Ease military alert",
    "180": "Yield",
    "181": "Ease administrative sanctions",
    "182": "Ease military blockade",
    "183": "Accede to demands for change in leadership",
    "184": "Return, release",
    "185": "Ease military alert",
    "186": "Yield",
    "190": "Use unconventional mass violence",
    "191": "Use biological weapons",
    "192": "Use chemical weapons",
    "193": "Use radiological weapons",
    "194": "Use nuclear weapons",
    "195": "Use force",
    "196": "Use unconventional mass violence",
}
