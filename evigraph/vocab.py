"""Fixed values the operators' results depend on. Every list can be replaced by an argument."""

# --- Fixed values: kinds and relation types -------------------------------------------------------------------

NODE_KINDS = ("band", "guitarist", "artist", "guitar", "guitar_brand", "genre")
RELATION_TYPES = (
    "member_of", "collaboration", "influenced_by", "associated_genre",
    "plays", "made_by", "signature_instrument", "related",
)
PERSON_KINDS = ("artist", "guitarist")
MUSIC_ENTITY_KINDS = ("band", "artist", "guitarist")
LAYOUT_ZONES = (
    "roots-blues", "jazz", "rock-circuit", "psychedelia-prog", "hard-rock-metal", "punk-alt", "folk-country-vise", "country-roots",
    "guitar-workshop", "guitar-genres",
)
MODE_KINDS = {
    "artists": ("band", "guitarist", "artist", "genre"),
    "guitars": ("guitar", "guitar_brand", "genre"),
}
KIND_LABELS = {
    "band": "Band",
    "guitarist": "Guitarist",
    "artist": "Artist",
    "guitar": "Guitar",
    "guitar_brand": "Guitar brand",
    "genre": "Genre",
}
KIND_ORDER = {"genre": 0, "band": 1, "guitarist": 2, "artist": 3, "guitar_brand": 4, "guitar": 5}
FRONTIER_PRIORITY = {"guitarist": 10, "artist": 9, "band": 8, "genre": 7, "guitar": 6, "guitar_brand": 5}
SEED_PRIORITY = {"genre": 11, "guitarist": 10, "artist": 9, "band": 8, "guitar": 5, "guitar_brand": 4}

# --- Fixed values: evidence signals ---------------------------------------------------------------------------

SIGNAL_LABEL = r"(?i)^wikipedia (?:link|category) signal$"
SIGNAL_CONTEXT = r"(?i)^wikipedia (?:link|category):"
MEMBERSHIP_TYPE_ID = "5be4c609-9afa-4ea0-910b-12ffb71e3821"

# --- Fixed values: patterns -----------------------------------------------------------------------------------

SLUG = r"^[a-z0-9][a-z0-9-]*$"
PARTIAL_DATE = r"^\d{4}(?:-\d{2}){0,2}$"
SUPERLATIVE = r"(?i)\b(first|only|largest|most|oldest|youngest)\b"
RECENT_YEAR = r"\b(19[2-9]\d|20[0-2]\d)\b"
ANY_YEAR = r"\b(1[6-9]\d{2}|20[0-2]\d)\b"
DISAMBIGUATION = (
    r"(?i)\s*\((?=[^)]*(?:artist|band|drummer|guitarist|music group|musician|singer))[^)]*\)\s*$"
)
TRANSLITERATION = (("Æ", "Ae"), ("Ø", "O"), ("Å", "A"), ("æ", "ae"), ("ø", "o"), ("å", "a"))
ITEM_URL = r"^https?://(?:www\.)?wikidata\.org/wiki/(Q\d+)(?:[?#].*)?$"
ARTIST_URL = r"(?i)^https://musicbrainz\.org/artist/([0-9a-f-]{36})(?:[/?#]|$)"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# --- Fixed values: sources ------------------------------------------------------------------------------------

SOURCE_HOSTS = {
    "en.wikipedia.org": "wikipedia",
    "www.wikidata.org": "wikidata",
    "wikidata.org": "wikidata",
    "musicbrainz.org": "musicbrainz",
    "www.musicbrainz.org": "musicbrainz",
}
QUALITY_PROVIDERS = ("wikipedia", "wikidata", "wikimedia", "musicbrainz")
QUALITY_HOSTS = r"(wikipedia|wikidata|musicbrainz)[^a-z0-9]+org"

# --- Fixed values: title scope --------------------------------------------------------------------------------

GENERIC_PREFIXES = ("category:", "history of ", "list of ", "music of ")
WEAK_SOURCES = ("category", "template", "navbox")
OUT_OF_SCOPE_EXACT = (
    "bandcamp daily", "baker's biographical dictionary of musicians", "brain", "bundesverband musikindustrie",
    "guitar player", "guitar world", "lead guitar", "musicians institute", "revolver", "rolling stone",
)
OUT_OF_SCOPE_TERMS = (
    "allmusic", "award", "awards", "bandcamp", "bandcamp daily", "billboard", "biographical dictionary", "charts",
    "concert", "database", "discogs", "encyclopedia", "festival", "grammy", "guitar player", "guitar world",
    "hall of fame", "kerrang", "magazine", "media", "musicbrainz", "newspaper", "pitchfork", "platform",
    "publication", "publisher", "radio station", "rate your music", "record company", "record label",
    "record store", "research brain", "spotify", "streaming", "television", "venue", "website", "youtube",
)
RELEASE_TERMS = (
    "album", "albums", "discography", "ep", "eps", "single", "singles", "song", "songs", "track", "tracks",
)
PAGE_RELEASE_TERMS = ("album", "albums", "discography", "single", "singles", "song", "songs", "track")
MAINTENANCE_TERMS = (
    "articles", "births", "commons category", "deaths", "living people", "pages", "stub", "templates", "wikipedia",
)
COLLECTION_TERMS = (
    "albums", "artists", "bands", "births", "deaths", "discographies", "genres", "guitarists", "members",
    "music groups", "musical groups", "musicians", "people", "record labels", "singers", "songwriters", "songs",
)
GENERIC_TOPICS = (
    "all-female band", "artist", "bass guitar", "backup band", "band", "band (rock and pop)", "bandleader",
    "guitarist", "house band", "musician", "military band", "one-man band", "tribute band",
)
GROUPING_GENRE_TERMS = (
    "duos", "trios", "quartets", "groups", "musicians", "artists", "bands", "singers", "songwriters", "people",
    "albums", "songs", "record labels", "companies", "supergroups",
)
SEED_GROUPING_TERMS = GROUPING_GENRE_TERMS[:-1]
BLOCKED_SEED_LABELS = ("bandcamp", "bandcamp daily")

# --- Fixed values: page subject terms -------------------------------------------------------------------------

PAGE_KIND_TERMS = {
    "band": (
        "band", "musical group", "music group", "duo", "ensemble", "music project",
        "hip hop collective", "musical collective", "music collective",
    ),
    "artist": (
        "musician", "guitarist", "singer", "rapper", "composer", "songwriter",
        "keyboardist", "percussionist", "drummer", "bassist", "pianist", "vocalist",
    ),
    "guitarist": ("guitarist", "musician", "singer", "songwriter"),
}
SUBJECT_TERMS = {
    "genre": ("genre", "style of music", "musical style"),
    "guitar": ("guitar",),
    "guitar_brand": ("guitar manufacturer", "musical instrument manufacturer"),
}
MUSIC_TERMS = (
    "acoustic", "artist", "banjo", "band", "bass", "blues", "country", "electric", "fender", "folk", "funk", "gibson", "guitar", "guitarist",
    "hard rock", "heavy metal", "ibanez", "jazz", "metal", "music", "musician", "punk", "rickenbacker", "rock",
    "songwriter",
)
TITLE_SUFFIXES = {
    "band": ("band",),
    "artist": ("musician", "singer"),
    "guitarist": ("guitarist", "musician"),
}
DESCRIPTORS = {
    "band": ("band", "musical group", "music group"),
    "artist": ("singer", "musician", "composer", "rapper", "songwriter", "record producer"),
    "guitarist": ("guitarist", "musician"),
}
BAND_CLASS = (
    r"(?i)\b(band|musical group|music group|musical ensemble|orchestra|duo|trio|quartet|choir|hip hop group)\b"
)
PERSON_OCCUPATION = (
    r"(?i)\b(musician|singer|composer|guitarist|songwriter|rapper|conductor|pianist|producer|keyboardist|"
    r"drummer|bassist|violinist|vocalist|disc jockey)\b"
)
EARLY_ROLE = (
    r"(?i)\b(composer|musician|singer|guitarist|instrumentalist|pianist|violinist|cellist|conductor|organist|"
    r"harpsichordist|songwriter|sitarist|saxophonist|trumpeter|bandleader|hymnist|musicologist|operatic soprano)\b"
)
SECONDARY_RELEASES = ("Compilation", "Live", "Remix", "Interview", "Audiobook")

# --- Fixed values: zone keywords in order of precedence -------------------------------------------------------

JAZZ_TITLES = (
    "louis armstrong", "duke ellington", "charlie parker", "miles davis", "john coltrane", "swing music", "bebop",
)
COUNTRY_TITLES = (
    "jimmie rodgers", "the carter family", "hank williams", "bill monroe", "patsy cline", "merle haggard",
    "honky-tonk",
)
PUNK_ALT_TERMS = (
    "alternative", "bad religion", "black flag", "hardcore punk", "horror punk", "indie rock", "misfits",
    "post-punk", "punk", "ramones", "shoegaze", "suicidal tendencies", "the good the bad and the zugly",
)
PROG_TERMS = (
    "dream theater", "frank zappa", "mike portnoy", "portnoy", "prog", "progressive", "psychedelic", "space rock",
)
HARD_ROCK_METAL_TERMS = (
    "accept", "acdc", "annihilator", "anthrax", "apocalyptica", "artillery", "as i lay dying", "avenged sevenfold",
    "bathory", "black sabbath", "body count", "caliban", "carcass", "death metal", "dio", "doom", "edguy",
    "george lynch", "gojira", "halford", "hard rock", "heavy metal", "iron maiden", "judas priest", "kiss", "metal",
    "metallica", "megadeth", "pantera", "power metal", "primal fear", "savatage", "sabbath", "sebastian bach",
    "skid row", "speed metal", "sneap", "thrash",
)
ZONE_TAIL_TERMS = (
    ("jazz", ("jazz", "bebop", "swing")),
    ("country-roots", ("country", "bluegrass", "honky tonk", "honky-tonk")),
    ("folk-country-vise", ("folk", "vise", "sunde")),
    ("roots-blues", ("blues", "soul", "gospel")),
    ("psychedelia-prog", ("prog", "psychedelic", "art rock")),
)

# --- Fixed values: era hints (pattern, year), first match wins ------------------------------------------------

ERA_HINTS = (
    (r"robert johnson|lead belly|muddy waters|blues|swing|country", 1948),
    (r"beatles|hendrix|cream|psychedelic|progressive|black sabbath|led zeppelin", 1969),
    (r"punk|ramones|misfits|sex pistols|hard rock|heavy metal|van halen|judas priest", 1978),
    (r"thrash|metallica|megadeth|hip hop|rap|g funk|gangsta", 1988),
    (r"grunge|alternative|post grunge|nu metal|symphonic|gothic", 1998),
    (r"kvelertak|beartooth|a wake in providence|modern", 2010),
)
ERA_DEFAULT = 1984
EARLIEST_YEAR_HINTS = (
    (
        r"robert johnson|lead belly|sister rosetta|muddy waters|b\.b\. king|bb king|chuck berry|rockabilly|blues|"
        r"folk|country",
        1935,
    ),
    (
        r"beatles|yardbirds|cream|hendrix|pink floyd|black sabbath|led zeppelin|deep purple|rolling stones|the who|"
        r"santana|hard rock|heavy metal|prog|psychedelic",
        1968,
    ),
    (
        r"punk|ramones|misfits|judas priest|iron maiden|van halen|ac\/dc|metallica|megadeth|thrash|doom|post-punk|"
        r"new wave",
        1982,
    ),
    (r"hip hop|hip-hop|rap|gangsta|g-funk|n\.w\.a|nwa|public enemy|tupac|dr\. dre|eminem", 1992),
    (
        r"grunge|alternative|dream theater|progressive metal|pantera|black metal|death metal|power metal|symphonic|"
        r"gothic",
        1994,
    ),
    (r"kvelertak|gojira|beartooth|atreyu|all that remains|a wake in providence|caliban", 2010),
)
EARLIEST_YEAR_DEFAULT = 1988

# --- Fixed values: sentence rules for fact leads (category, base score, pattern) ------------------------------

NAME_ORIGIN = (
    r"(?i)\b(originally known as|previously known as|originally called|named after|named for|name from|"
    r"name came from|name derives from|name is derived from|name was taken from|"
    r"took (?:their|its|his|her) name from|began as|started as)\b"
)
NAME_CONTEXT = (
    r"(?i)\b(?:band|group)(?:'s)? name\b.*\b(?:after|from|derived|inspired|suggested|chose|coined|adopted)\b"
)
SENTENCE_RULES = (
    ("name-origin", 5, NAME_ORIGIN + "|" + NAME_CONTEXT),
    (
        "instrument-story", 4,
        r"(?i)\b(?:built|constructed|made|designed|modified)\b.{0,85}\b(?:guitar|instrument)\b|"
        r"\b(?:guitar|instrument)\b.{0,85}\b(?:built|constructed|made|designed|modified)\b",
    ),
    (
        "playing-technique", 5,
        r"(?i)\b(?:lost|burned|injured|damaged)\b.{0,90}\b(?:finger|hand|fingertip)s?\b|"
        r"\b(?:finger|hand|fingertip)s?\b.{0,90}\b(?:lost|burned|injured|damaged)\b|"
        r"\b(?:retaught himself|relearned)\b.{0,80}\b(?:guitar|play)\b",
    ),
    (
        "stage-identity", 4,
        r"(?i)\b(?:wore|wearing|adopted|used|designed|created|tried)\b.{0,85}"
        r"\b(?:costume|mask|uniform|stage persona|makeup|make-up|face paint)s?\b",
    ),
    (
        "recording-story", 4,
        r"(?i)\b(?:recorded|mixed|tracked)\b.{0,100}"
        r"(?:\b(?:\d+|one|two|three|four|five|six|seven)\s+(?:hours|days|weeks)\b|"
        r"\b(?:in|at|inside)\s+(?:(?:a|the|his|their)\s+)?(?:basement|garage|bedroom|makeshift)\b)",
    ),
    (
        "performance-story", 4,
        r"(?i)\b(?:performed|played|concert|show|tour)\b.{0,110}"
        r"\b(?:headphones|antarctica|aircraft|boeing|prison|rooftop|satellite|hospital|ship)\b",
    ),
    (
        "cover-story", 4,
        r"(?i)\b(?:cover art|album cover|artwork)\b.{0,100}"
        r"\b(?:created|designed|photograph|featured|inflatable|painted)\b",
    ),
)
SURNAME_VERBS = (
    "was", "were", "is", "are", "had", "has", "lost", "built", "recorded", "tried", "retaught", "named", "created",
    "designed", "modified", "performed", "played", "wore", "used", "adopted", "made", "started", "began", "took",
    "relearned",
)

# --- Fixed values: review outcomes ----------------------------------------------------------------------------

FINAL_STATUSES = ("approved", "imported", "rejected")
POSITIVE_STATUSES = ("approved", "imported")
SOURCE_REASONS = ("duplicate", "wrong_entity", "weak_source", "weak_connection", "incorrect_fact")
DUPLICATE_PHRASES = ("duplicate", "already in graph", "existing node")

# Fixed value: the zone of instruments and their makers.
WORKSHOP_ZONE = "guitar-workshop"
