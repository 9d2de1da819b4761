"""Fixed values and thresholds used across the jobs.

Every table here is data, not logic: cemeteries can pass their own alias, code and
grammar tables to the jobs that take them.
"""

# ---- fixed values: nickname -> canonical first name ------------------------------------
NICKNAMES = {
    "abe": "abraham", "al": "albert", "alex": "alexander", "andy": "andrew", "art": "arthur", "barb": "barbara",
    "bart": "bartholomew", "bea": "beatrice", "becky": "rebecca", "bell": "isabella", "belle": "isabella",
    "ben": "benjamin", "bert": "albert", "bess": "elizabeth", "bessie": "elizabeth", "beth": "elizabeth",
    "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "carrie": "caroline", "cathy": "catherine", "charley": "charles", "charlie": "charles",
    "chas": "charles", "chris": "christopher", "chuck": "charles", "cindy": "cynthia", "dan": "daniel",
    "danny": "daniel", "dave": "david", "davy": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
    "don": "donald", "donnie": "donald", "dora": "dorothy", "dot": "dorothy", "dottie": "dorothy", "ed": "edward",
    "eddie": "edward", "edw": "edward", "effie": "euphemia", "ella": "eleanor", "ellen": "eleanor",
    "elsie": "elizabeth", "fannie": "frances", "fanny": "frances", "flo": "florence", "fran": "frances",
    "frank": "franklin", "fred": "frederick", "freddie": "frederick", "gene": "eugene", "geo": "george",
    "gerry": "gerald", "gus": "augustus", "hal": "harold", "hank": "henry", "hattie": "harriet", "harry": "henry",
    "herb": "herbert", "hetty": "henrietta", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jas": "james",
    "jen": "jennifer", "jennie": "jane", "jenny": "jane", "jerry": "gerald", "jim": "james", "jimmy": "james",
    "jno": "john", "johann": "john", "joe": "joseph", "joey": "joseph", "johnny": "john", "jos": "joseph",
    "josh": "joshua", "josie": "josephine", "kate": "catherine", "katie": "catherine", "kathy": "catherine",
    "ken": "kenneth", "kenny": "kenneth", "kit": "christopher", "larry": "lawrence", "len": "leonard",
    "lena": "helena", "leo": "leonard", "les": "leslie", "lettie": "letitia", "libby": "elizabeth", "lige": "elijah",
    "lizzie": "elizabeth", "liz": "elizabeth", "lon": "alonzo", "lottie": "charlotte", "lou": "louis",
    "louie": "louis", "lucy": "lucille", "mabel": "mabelle", "maggie": "margaret", "mame": "mary", "mamie": "mary",
    "mandy": "amanda", "margie": "margaret", "marty": "martin", "mat": "matthew", "matt": "matthew",
    "mattie": "martha", "max": "maxwell", "meg": "margaret", "mel": "melvin", "mike": "michael", "millie": "mildred",
    "mina": "wilhelmina", "minnie": "minerva", "mollie": "mary", "molly": "mary", "nan": "nancy", "nancy": "ann",
    "nate": "nathan", "ned": "edward", "nell": "eleanor", "nellie": "eleanor", "nettie": "henrietta",
    "nick": "nicholas", "nora": "eleanora", "pam": "pamela", "pat": "patrick", "patsy": "patricia",
    "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "polly": "mary",
    "ray": "raymond", "rich": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "robt": "robert",
    "rod": "roderick", "ron": "ronald", "ronnie": "ronald", "rose": "rosemary", "roxie": "roxanne", "rudy": "rudolph",
    "russ": "russell", "sadie": "sarah", "sallie": "sarah", "sally": "sarah", "sam": "samuel", "sammy": "samuel",
    "sandy": "sandra", "sherm": "sherman", "sid": "sidney", "sol": "solomon", "stan": "stanley", "steve": "stephen",
    "sue": "susan", "susie": "susan", "ted": "theodore", "teddy": "theodore", "terry": "terrence", "thos": "thomas",
    "tillie": "matilda", "tim": "timothy", "timmy": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trish": "patricia", "vic": "victor", "vin": "vincent", "viv": "vivian", "walt": "walter", "wes": "wesley",
    "will": "william", "willie": "william", "wm": "william", "zach": "zachary", "zeke": "ezekiel",
}

# ---- fixed values: name cleaning patterns ----------------------------------------------
NAME_PUNCT = "[\"“”'’`.]"
NAME_TITLES = (
    r"\b(jr|sr|ii|iii|iv|rev|dr|mr|mrs|col|capt|sgt|ssgt|msgt|lt|gen|pvt|cpl|pfc|sp4|sp5|maj"
    r"|cmdr|ens|adm)\b"
)
NAME_SUFFIX_TAIL = r"(?i)(?:\s+(?:jr|sr|ii|iii|iv|v)\.?,?)+$"
YEAR = r"\b(1[6-9]\d\d|20\d\d)\b"

# ---- fixed values: plot text patterns (generic profile) --------------------------------
PLOT_JUNK = r"(?i)no location|unknown|pottersfield|interment record only"
PLOT_SUB = r"(?i)\bSub\.?\s*:?\s*(\d+)\b"
PLOT_BLOCK = r"(?i)\b(?:Blk|Block|Row)[\s\-:#]*([A-Z]{1,2}|\d{1,3}[A-Z]?)\b"
PLOT_LOT = r"(?i)\bLot[\s\-:#]*([A-Z0-9]+(?:[-/][A-Z0-9]+)?)\b"
PLOT_GRAVE = r"(?i)\b(?:Grave|Space|Sp)[\s\-:#]*([A-Z0-9]+(?:[-/][A-Z0-9]+)?)\b"
PLOT_TOKEN = r"(?i)\bPlot[\s\-:#]*([A-Z0-9]+(?:[-/][A-Z0-9]+)?)\b"
PLOT_SECTION = r"(?i)\bSec(?:t?ion)?[\s\-.:#]*([A-Za-z0-9]+)\b"
PLOT_SECTION_NOT = r"(?i)^(lot|blk|block|row|grave|space)$"
PLOT_LEAD = r"(?i)^(.*?)\s*\b(?:Blk|Block|Row|Sub|Lot|Grave|Space|Sp)\b"
PLOT_RECORD_ID = r"(?i)\b(?:id|no)\s*#?\s*\d+\b"
PLOT_LONG_NUMBER = r"\b\d{3,}\b"
PLOT_HALF_LOT = r"(?i)^[NSEW]\.?\s*\d/\d$"
PLOT_LOT_LETTER = r"^(\d{1,4})\s*-?\s*([A-Za-z])$"
PLOT_BARE_NAME = r"^[A-Za-z][A-Za-z .'&]{2,29}$"
PLOT_BARE_NAME_NOT = r"(?i)^(unknown|none|n/?a)$"

# ---- fixed values: plot text patterns (aliased profile) --------------------------------
ALIASED_SUB = r"(?i)\bSub\.?\s*:?\s*(\d+)\b"
ALIASED_BLOCK = r"(?i)\b(?:Blk|Block|Row)\s+([A-Z]{1,2}|\d{1,3})\b"
ALIASED_LOT = r"(?i)\bLot:?\s*#?\s*([A-Z0-9]+(?:[-/][A-Z0-9]+)?)\b"
ALIASED_GRAVE = r"(?i)\b(?:Grave|Space|Plot)\s+([0-9]+(?:[-/][0-9]+)?)\b"

# ---- fixed values: ordered section aliases of the one aliased cemetery ------------------
SECTION_ALIASES = [
    (r"(?i)^(?:sub\.?\s*12\s+)?hoff?stett?er\s+hil?l?|^hostetter\s+hill", "Hofstetter Hill"),
    (r"(?i)^squ?are?\s+hh?il?l|^section\s+11|^sub\s+11", "Square Hill"),
    (r"(?i)^round\s+hill|^sub\s+10", "Round Hill"),
    (r"(?i)^north\s?hill|^sub\s+17", "North Hill"),
    (r"(?i)^cutler\s+hill|^culter\s+hill|^sub\s+13", "Cutler Hill"),
    (r"(?i)^vault\s+hill|^sub\s+6\b", "Vault Hill"),
    (r"(?i)^morris\s+hill|^sub\s+15", "Morris Hill"),
    (r"(?i)^veterans?\s+hill|^sub\s+16", "Veteran Hill"),
    (r"(?i)^mausoleum|^sub\s+9\b", "Mausoleum"),
    (r"(?i)^singles?(\s+grave)?(\s+sec(tion)?)?\b|^sub\s+14", "Single Grave"),
    (r"(?i)^old\s+part|^sub\s+[1-5]\b", "Old Part"),
    (r"(?i)oak\s+hill|^sub\.?\s*7\b|^subdiv\s+7|^section\s+7\b", "Oak Hill"),
]
SUB_FROM_BLOCK_SECTION = "Old Part"
SUB_FROM_TEXT = r"(?i)^old\s+part\s+(?:sec(?:tion)?\s+)?([1-5])\b"

# ---- fixed values: register section codes of the one coded cemetery ---------------------
CODED_CEMETERY = "OAKGROVE"
SECTION_CODES = {
    "01": ("Old Part", "1"), "02": ("Old Part", "2"), "03": ("Old Part", "3"),
    "04": ("Old Part", "4"), "05": ("Old Part", "5"), "06": ("Vault Hill", ""),
    "07": ("Oak Hill", ""), "09": ("Mausoleum", ""), "10": ("Round Hill", ""),
    "11": ("Square Hill", ""), "12": ("Hofstetter Hill", ""), "13": ("Cutler Hill", ""),
    "14": ("Single Grave", ""), "15": ("Morris Hill", ""), "16": ("Veteran Hill", ""),
    "17": ("North Hill", ""), "25": ("", ""),
}
PLOT_CODE = r"(?i)^([A-Z]+)-(\d+)-([A-Z0-9]*)-([A-Z0-9]*)-?([0-9]*)$"
# sections drawn by lot number only: their block is not part of the plot key
LOTS_ONLY_SECTIONS = ("Old Part", "Oak Hill")
SINGLE_GRAVE_SECTION = "Single Grave"

# ---- fixed values: number words of walk-order transcripts -------------------------------
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()

# ---- fixed values: 16-point compass ----------------------------------------------------
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()

# ---- fixed values: geodesy -------------------------------------------------------------
EARTH_M = 6371000.0
EARTH_MILES = 3958.8
MERC_R = 6378137.0
DEFAULT_DECLINATION = -6.6

# ---- fixed values: link gates ----------------------------------------------------------
LINK_ACCEPT, LINK_MARGIN, LINK_MAYBE = 70, 15, 55
REQUEST_ACCEPT, REQUEST_RELAXED = 70, 58
UNIQUE_SCORE, ERA_SCORE = 62, 60

# ---- fixed values: position-code grammars (field, pattern, section/block/lot/grave) -----
# Each part is either a literal or "$n" (group n as an integer), "^n" (group n upper-cased
# with zero padding stripped) or "~n" (group n as it stands).
POSITION_GRAMMARS = [
    ("Pritchard", "mapno", r"(?i)^S(\d+)-R(\d+)-(\d+)[ab]?$", "Section $1", "$2", "$3", ""),
    ("Elm Hall", "mapno", r"^(\d+)-(\d+)-(\d+)$", "Section $1", "$2", "$3", ""),
    ("St. Patricks-Irishtown", "mapno", r"(?i)^(\d+)-([a-z]+|\d+)-(\d+)$", "Section $1", "^2", "$3", ""),
    ("Riverdale", "plot", r"^R\s*-?(\d+)(?:--?(\d+))?$", "*", "", "$1", "$2"),
    ("Seville - French", "plot", r"^SC\s*(\d+)(?:-(\d+))?$", "*", "", "$1", "$2"),
    ("Brady", "plot", r"^B(\d+)-(\d+)$", "*", "", "$1", "$2"),
    ("Sibley-Welch", "plot", r"(?i)^S\s*Col\s*(\d+)\s*([A-Z]?)$", "*", "COL~1", "~2", ""),
    ("Sibley-Welch", "plot", r"^S(\d+)$", "*", "", "$1", ""),
]

# ---- fixed values: labels kept from register detail pages -------------------------------
REGISTER_LABELS = [
    "Name", "Former Name", "Sex", "Birth Date", "Burial Date", "Death Date",
    "Veteran", "Notes", "User 3", "Buriel at Foot", "Buriel at head",
    "Plot Number", "Section", "Block", "Lot", "Plot", "Status",
]
