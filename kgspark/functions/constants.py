"""Word lists, patterns, weights and templates that results depend on."""

# Characters Python treats as white space, and the matching expression.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"

# ASCII punctuation and English articles removed by answer normalisation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ["a", "an", "the"]

# Vocabulary specials.
ENTITY_SPECIALS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "<MASK>"]
RELATION_SPECIALS = ["<PAD>", "<UNK>", "<MASK>"]

# Words that make two relation names match when both last parts hold one of them.
RELATION_KEYWORDS = [
    "language", "birthplace", "birth", "death", "religion", "country", "capital", "president", "founder", "location",
    "spouse", "parent", "child", "team", "school", "university",
]

# Question type rules, tried in this order, and the hop range of each type.
DEFINITIONAL_PATTERNS = [
    r"^what is a\b", r"^what are\b", r"\bdefine\b", r"\bdefinition of\b", r"\bmeaning of\b", r"\btype of\b",
    r"\bkind of\b", r"\bcategory\b", r"^is .+ a\b",
]
LITERAL_PATTERNS = [
    r"\bwhen (was|did|is)\b", r"\bwhat (year|date|day|time)\b", r"\bhow (old|long|many|much)\b", r"\bbirthday\b",
    r"\bborn\b", r"\bdied\b", r"\bfounded\b", r"\bestablished\b", r"\bnumber of\b", r"\bpopulation\b", r"\bheight\b",
    r"\bweight\b", r"\bage\b",
]
TWO_HOP_PATTERNS = [
    r"'s .+'s", r"'s .+ 's", r"\b(and|or) (what|who|where|when)\b", r"\bthrough\b", r"\bvia\b", r"\bsister.+brother\b",
    r"\bbrother.+wife\b", r"\bwife.+mother\b", r"\bfather.+brother\b", r"\bparent.+child\b", r"\brelated to\b",
    r"\bconnected to\b", r"\blinked to\b",
]
ONE_HOP_KEYWORDS = [
    "wife", "husband", "spouse", "married", "father", "mother", "parent", "child", "children", "brother", "sister",
    "sibling", "capital", "country", "city", "state", "continent", "director", "actor", "actress", "starring", "author",
    "wrote", "written by", "plays", "played", "play", "born", "died", "nationality", "language", "currency", "religion",
    "founder", "ceo", "president", "leader",
]
HOP_RANGES = {"literal": (1, 1), "definitional": (1, 1), "one_hop": (1, 2), "two_hop": (2, 5)}

# Text cues of the two labelling rules for question types.
LABEL_V1_DEFINITIONAL = ["what is a", "what are", "define", "type of"]
LABEL_V1_LITERAL = ["when was", "how many", "what year", "birthday", "born"]
LABEL_V2_DEFINITIONAL = [
    "what is a ", "what are ", "what is the meaning", "what kind of", "what type of", "define ", "what does ", "what do ",
]
LABEL_V2_LITERAL = [
    "when was", "when did", "when is", "what year", "what date", "what day", "how old", "how many", "how much",
    "how long", "how tall", "how big", "birthday", "birth date", "born", "population", "number of", "count", "age of",
    "height of", "weight of",
]

# Words that never count as entities (full and fast rule sets).
STOP_WORDS = [
    "what", "who", "where", "when", "which", "how", "why", "whom", "whose", "does", "did", "do", "is", "are", "was",
    "were", "can", "could", "would", "should", "will", "shall", "may", "might", "has", "have", "had", "be", "been",
    "being", "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "but", "not",
    "no", "yes", "this", "that", "these", "those", "it", "its", "they", "them", "their", "he", "she", "him", "her",
    "his", "hers", "we", "us", "our", "you", "your", "i", "me", "my",
]
STOP_WORDS_FAST = [
    "what", "who", "where", "when", "which", "how", "why", "whom", "whose", "does", "did", "do", "is", "are", "was",
    "were", "can", "could", "would", "should", "will", "shall", "may", "might", "has", "have", "had", "be", "been",
    "being", "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "about", "before", "after",
    "during", "else", "also", "other", "some", "any", "play", "plays", "played", "speak", "speaks", "spoke", "called",
    "located", "live", "lives", "lived", "born", "died", "made", "part", "kind", "type", "today", "now", "then",
    "there", "here", "first", "last", "next", "up", "down", "end", "start", "begin",
]

# Adjectives of origin and belief and the entity they stand for (full and fast rule sets).
DEMONYMS = {
    "jamaican": "Jamaica", "american": "United States", "british": "United Kingdom", "french": "France",
    "german": "Germany", "italian": "Italy", "spanish": "Spain", "chinese": "China", "japanese": "Japan",
    "korean": "Korea", "russian": "Russia", "indian": "India", "canadian": "Canada", "australian": "Australia",
    "mexican": "Mexico", "brazilian": "Brazil", "egyptian": "Egypt", "israeli": "Israel", "iranian": "Iran",
    "iraqi": "Iraq", "swedish": "Sweden", "norwegian": "Norway", "danish": "Denmark", "finnish": "Finland",
    "dutch": "Netherlands", "belgian": "Belgium", "swiss": "Switzerland", "austrian": "Austria", "polish": "Poland",
    "czech": "Czech Republic", "greek": "Greece", "turkish": "Turkey", "thai": "Thailand", "vietnamese": "Vietnam",
    "indonesian": "Indonesia", "malaysian": "Malaysia", "philippine": "Philippines", "filipino": "Philippines",
    "nigerian": "Nigeria", "kenyan": "Kenya", "south african": "South Africa", "argentine": "Argentina",
    "colombian": "Colombia", "chilean": "Chile", "peruvian": "Peru", "venezuelan": "Venezuela", "islamic": "Islam",
    "christian": "Christianity", "jewish": "Judaism", "buddhist": "Buddhism", "hindu": "Hinduism", "muslim": "Islam",
}
DEMONYMS_FAST = {
    "jamaican": "Jamaica", "american": "United States", "british": "United Kingdom", "french": "France",
    "german": "Germany", "italian": "Italy", "spanish": "Spain", "chinese": "China", "japanese": "Japan",
    "korean": "Korea", "russian": "Russia", "indian": "India", "canadian": "Canada", "australian": "Australia",
    "mexican": "Mexico", "brazilian": "Brazil", "egyptian": "Egypt", "islamic": "Islam", "swedish": "Sweden",
    "indonesian": "Indonesia", "uk": "United Kingdom", "u.s.": "United States", "u.s": "United States",
    "us": "United States",
}

# Well-known names as they are typed in questions and their entity.
COMMON_NAMES = {
    "james k polk": "James K. Polk", "james k. polk": "James K. Polk", "george washington": "George Washington",
    "george w bush": "George W. Bush", "george w. bush": "George W. Bush", "richard nixon": "Richard Nixon",
    "kennedy": "John F. Kennedy", "jfk": "John F. Kennedy", "lincoln": "Abraham Lincoln", "obama": "Barack Obama",
    "trump": "Donald Trump", "biden": "Joe Biden", "justin bieber": "Justin Bieber",
    "ben franklin": "Benjamin Franklin", "benjamin franklin": "Benjamin Franklin",
    "natalie portman": "Natalie Portman", "cam newton": "Cam Newton", "andy murray": "Andy Murray",
    "niall ferguson": "Niall Ferguson", "keyshia cole": "Keyshia Cole", "jackie robinson": "Jackie Robinson",
    "rihanna": "Rihanna", "michael buble": "Michael Bublé", "george orwell": "George Orwell",
    "adolf hitler": "Adolf Hitler", "george lopez": "George Lopez", "edgar allan poe": "Edgar Allan Poe",
    "martin luther king": "Martin Luther King Jr.", "eleanor roosevelt": "Eleanor Roosevelt",
    "harper lee": "Harper Lee", "anna bligh": "Anna Bligh", "george clemenceau": "Georges Clemenceau",
    "george washington carver": "George Washington Carver", "william henry harrison": "William Henry Harrison",
    "ken barlow": "Ken Barlow", "draco malfoy": "Draco Malfoy", "mr gray": "Christian Grey",
    "mr grey": "Christian Grey", "jamarcus russell": "JaMarcus Russell", "john noble": "John Noble",
    "joakim noah": "Joakim Noah", "fukushima": "Fukushima Daiichi Nuclear Power Plant",
    "fukushima daiichi": "Fukushima Daiichi Nuclear Power Plant", "ohio": "Ohio", "louisiana": "Louisiana",
    "utah": "Utah", "sweden": "Sweden", "arizona": "Arizona", "atlanta": "Atlanta",
    "galapagos": "Galápagos Islands", "frederick": "Frederick", "kansas city": "Kansas City", "samsung": "Samsung",
    "nfl": "NFL", "redskins": "Washington Redskins", "coronation street": "Coronation Street",
    "star wars": "Star Wars", "lord of the rings": "The Lord of the Rings", "annie": "Annie",
    "st augustine": "Augustine of Hippo", "saint augustine": "Augustine of Hippo",
}

# Named-entity labels that count as entities, and the scores of the spotting rules.
SPAN_LABELS = ["PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "EVENT", "WORK_OF_ART", "PRODUCT"]
SPAN_SCORES = {"named": 0.95, "chunk": 0.7, "capitalised": 0.8, "demonym": 0.85, "pattern": 0.75, "quoted": 0.9}

# Cue words in a question and the relation words appended for them.
QUERY_EXPANSIONS = [
    (["speak", "language", "languages"], "language_spoken language"),
    (["born", "from", "birthplace", "hometown", "where"], "place_of_birth birthplace location"),
    (["died", "death"], "place_of_death death"),
    (["religion", "religious"], "religion religious_belief"),
    (["president", "leader", "ruler", "govern"], "president leader government head_of_government"),
    (["founded", "founder", "created"], "founder organization_founded"),
    (["married", "spouse", "wife", "husband"], "spouse marriage partner"),
    (["capital"], "capital administrative_capital"),
    (["team", "play"], "team sports_team championships"),
    (["wrote", "author", "book", "written"], "works_written author compositions"),
    (["profession", "job", "occupation", "do", "did", "work"], "profession occupation employment"),
    (["star", "actor", "film", "movie"], "film actor performance"),
    (["country", "nation"], "country nationality"),
]

# Cue words in a question and the relation word looked for one hop away.
ONE_HOP_TRIGGERS = [
    (["language", "speak"], "language"), (["born", "from", "birthplace"], "birth"), (["died", "death"], "death"),
    (["president"], "president"), (["capital"], "capital"), (["religion"], "religion"),
    (["founder", "founded"], "founder"), (["team"], "team"),
]

# Subject domains and their cue words.
DOMAIN_WORDS = {
    "person": ["who", "person", "people", "born", "married", "wife", "husband", "father", "mother", "brother", "sister",
               "child", "children", "parent"],
    "location": ["where", "country", "city", "state", "located", "capital", "continent", "island"],
    "film": ["movie", "film", "actor", "actress", "directed", "starring", "character", "play"],
    "music": ["song", "album", "singer", "band", "music", "wrote", "composed"],
    "time": ["when", "year", "date", "born", "died", "founded"],
    "government": ["president", "leader", "government", "political", "party", "election"],
}

# Word in the last relation of a path and the kind of answer it announces (first rule wins).
ANSWER_TYPES = {
    "place_of_birth": "place/city", "place_of_death": "place/city", "location": "place/location",
    "country": "country", "capital": "city", "language": "language", "languages_spoken": "language",
    "official_language": "language", "religion": "religion", "nationality": "nationality/country",
    "form_of_government": "government type", "championships": "championship/year", "sport": "sport",
    "president": "person name", "vice_president": "person name", "office_holder": "person name",
    "founder": "person/organization", "inventor": "invention", "inventions": "invention", "team": "team name",
    "mascot": "mascot", "spouse": "person name", "parent": "person name", "child": "person name",
    "currency": "currency", "airport": "airport name", "school": "school/university",
}

# Openings that answer cleaning removes, and text templates.
ANSWER_PREFIXES = [
    "The answer is ", "Answer: ", "Based on the paths, ", "The specific entity is ", "According to the knowledge graph, ",
]
INSTRUCTION = (
    "Given a question about a knowledge graph, generate the full reasoning paths "
    "(including entities and relations) that connect the question entity to the answer entity."
)
