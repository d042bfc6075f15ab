"""Word lists, thresholds and patterns that results depend on."""

BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
FILLERS = ("আচ্ছা", "হ্যালো", "ভাই", "বন্ধু", "দোস্ত", "please", "plz", "pls", "bro", "dude")
QUESTION_MARKERS = ("কি", "কী", "কে", "কার", "কাকে", "কোন", "কোথায়", "কখন", "কবে", "কেন", "কীভাবে", "কতটুকু", "কত", "কতটি", "কতজন", "কীসের", "কীসে")
WH_WORDS = ("who", "what", "when", "where", "why", "how", "which")
#: Characters mapped one to one by the punctuation map, their images, and the removed ones.
PUNCTUATION_FROM = "।॥ –—“”‘’‌‍​"
PUNCTUATION_TO = ".. --\"\"''"

TOPICS = {
    "History": ("মুক্তিযুদ্ধ", "স্বাধীনতা", "independence", "liberation", "war", "মুজিব", "mujib", "বঙ্গবন্ধু", "bangabandhu", "1971", "ভাষা আন্দোলন", "language movement", "partition", "দেশভাগ", "রাজনীতি", "politics", "সংবিধান", "constitution"),
    "Geography": ("রাজধানী", "capital", "নদী", "river", "পাহাড়", "mountain", "বন", "forest", "সমুদ্র", "ocean", "sea", "জেলা", "district", "বিভাগ", "division", "সীমানা", "border", "অবস্থান", "located", "সুন্দরবন", "sundarbans", "পদ্মা", "padma", "মেঘনা", "যমুনা"),
    "Science": ("বিজ্ঞান", "science", "আবিষ্কার", "invention", "প্রযুক্তি", "technology", "পদার্থ", "physics", "রসায়ন", "chemistry", "জীববিজ্ঞান", "biology", "গণিত", "mathematics"),
    "Economy": ("অর্থনীতি", "economy", "জিডিপি", "gdp", "বাজেট", "budget", "রপ্তানি", "export", "আমদানি", "import", "ব্যাংক", "bank", "মুদ্রা", "currency", "টাকা", "taka", "বিনিয়োগ", "investment"),
    "Culture": ("সংস্কৃতি", "culture", "সাহিত্য", "literature", "কবি", "poet", "লেখক", "writer", "শিল্প", "art", "সংগীত", "music", "রবীন্দ্রনাথ", "tagore", "নজরুল", "nazrul", "উৎসব", "festival"),
    "International": ("জাতিসংঘ", "united nations", "un", "বিশ্ব", "world", "আন্তর্জাতিক", "international", "চুক্তি", "treaty", "সম্মেলন", "summit", "পুরস্কার", "award", "nobel", "নোবেল"),
    "Government": ("সরকার", "government", "প্রধানমন্ত্রী", "prime minister", "রাষ্ট্রপতি", "president", "মন্ত্রণালয়", "ministry", "সংসদ", "parliament", "নির্বাচন", "election", "আইন", "law"),
    "Infrastructure": ("সেতু", "bridge", "সড়ক", "road", "রেলপথ", "railway", "বিমানবন্দর", "airport", "বন্দর", "port", "বিদ্যুৎ", "power", "পদ্মা সেতু", "padma bridge", "মেট্রো", "metro"),
}

#: Ordered groups of whole words or phrases; a bare four-digit number means when.
QUESTION_TYPES = (
    ("who_question", ("কে", "কার", "কাকে", "who", "কোন ব্যক্তি")),
    ("when_question", ("কখন", "কবে", "কত সালে", "when", "কোন সালে", "কোন তারিখে")),
    ("where_question", ("কোথায়", "কোন জায়গায়", "where", "কোন দেশে", "কোন শহরে")),
    ("numeric_ranking", ("কত", "কতটি", "কতজন", "কতটুকু", "কততম", "how many", "how much", "কোনটি বৃহত্তম", "largest", "smallest", "first", "second")),
    ("what_question", ("কি", "কী", "what", "কীসের", "কোনটি")),
    ("why_how_question", ("কেন", "কীভাবে", "why", "how")),
)
ENTITY_STOPS = ("who", "what", "when", "where", "why", "how", "which", "the", "and", "for", "bcs", "bangladesh")
KNOWN_ENTITIES = ("বাংলাদেশ", "ঢাকা", "চট্টগ্রাম", "রাজশাহী", "খুলনা", "বরিশাল", "সিলেট", "রংপুর", "ময়মনসিংহ", "শেখ মুজিবুর রহমান", "বঙ্গবন্ধু", "জিয়াউর রহমান", "পদ্মা", "মেঘনা", "যমুনা", "সুন্দরবন", "কক্সবাজার")
#: What a search in English adds to the keywords.
ENGLISH_SUFFIX = " Bangladesh BCS"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BANGLA_MONTHS = ("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর")
KEYWORD_STOPS = ("কি", "কী", "কে", "কোন", "কোথায়", "কখন", "কেন", "কীভাবে", "এবং", "বা", "ও", "তার", "তাদের", "এই", "সেই", "একটি", "the", "a", "an", "is", "are", "was", "were", "of", "in", "for", "and", "or", "to", "at", "by", "with")

RELIABLE_PUBLISHERS = ("Prothom Alo", "The Daily Star", "Bangladesh Sangbad Sangstha", "Bangladesh Bureau of Statistics", "bdnews24.com", "Banglapedia", "Wikipedia", "UNESCO", "World Bank", "IMF", "WHO", "UN")
ASSERTION_VERBS = ("is", "are", "was", "were", "has", "have", "had", "became", "established", "located", "known", "called", "founded", "divided", "achieved", "produced")
BANGLA_ASSERTIONS = ("হয়", "হয়েছে", "ছিল", "ছিলেন", "হলেন", "করেন", "করেছেন", "অবস্থিত", "প্রতিষ্ঠিত", "গঠিত")
WHO_TAGS = ("who", "কে", "কার", "কাকে", "president", "prime minister", "minister", "leader", "founder", "father", "রাষ্ট্রপতি", "প্রধানমন্ত্রী", "মন্ত্রী", "নেতা", "প্রতিষ্ঠাতা", "জনক", "সভাপতি", "পরিচালক", "চেয়ারম্যান")
WHEN_TAGS = ("when", "কখন", "কবে", "সালে", "সনে", *MONTHS, *BANGLA_MONTHS)
NUMERIC_TAGS = ("largest", "smallest", "highest", "lowest", "most", "least", "first", "second", "third", "সবচেয়ে", "বৃহত্তম", "ক্ষুদ্রতম", "সর্বোচ্চ", "সর্বনিম্ন", "প্রথম", "দ্বিতীয়", "তৃতীয়", "ranking", "ranked", "rank", "position", "number")
WHERE_TAGS = ("where", "কোথায়", "কোন জায়গায়", "located", "situated", "capital", "city", "district", "division", "country", "অবস্থিত", "রাজধানী", "শহর", "জেলা", "বিভাগ", "দেশ")
#: Substrings that make a person, a measure or a place the subject of a fact.
PERSON = ("রাষ্ট্রপতি", "প্রধানমন্ত্রী", "মন্ত্রী", "নেতা", "প্রতিষ্ঠাতা", "জনক", "সভাপতি", "সদস্য", "চেয়ারম্যান", "পরিচালক", "সম্পাদক", "সেনাপতি", "গভর্নর", "বিচারপতি", "president", "minister", "founder", "chairman", "director", "secretary", "commander", "governor", "chief")
MEASURE = ("কিলোমিটার", "মিটার", "হেক্টর", "বর্গ", "শতাংশ", "কোটি", "লক্ষ", "হাজার", "অনুচ্ছেদ", "ধারা", "উপধারা", "দফা", "km²", "percent", "%", "mw", "gw", "মেগাওয়াট", "গিগাওয়াট")
SQUARE_KM = r"sq\.?\s*km"
PLACE = ("রাজধানী", "সদর দপ্তর", "অবস্থিত", "সীমানা", "সীমান্ত", "capital", "headquarters", "located in", "situated in", "border")

BLOCKED_DOMAINS = ("facebook.com", "twitter.com", "instagram.com", "youtube.com", "reddit.com", "tiktok.com", "pinterest.com")
PUBLISHERS = (("en.wikipedia.org", "Wikipedia (EN)"), ("bn.wikipedia.org", "Wikipedia (BN)"), ("banglapedia.org", "Banglapedia"), ("bbs.gov.bd", "Bangladesh Bureau of Statistics"), ("thedailystar.net", "The Daily Star"), ("prothomalo.com", "Prothom Alo"), ("bdnews24.com", "bdnews24.com"), ("bbc.com", "BBC"))
#: Families of question patterns, case-insensitive. A Bengali word that ends in a vowel sign has its word end only before a letter.
HISTORICAL = (
    ("dates", r"(^|[^\p{L}\p{N}_])\p{Nd}{4}([^\p{L}\p{N}_]|$)|সালে|সনে"),
    ("treaties", r"চুক্তি|treaty|accord|agreement"),
    ("appointments", r"নিযুক্ত|appoint|elected|chairman|director"),
    ("rankings", r"rank|largest|smallest|first|প্রথম|বৃহত্তম"),
    ("organizations", r"un|unesco|who|imf|saarc|oic|wto|ngo|সংস্থা|organization"),
    ("locations", r"কোথায়|located|capital|district|division|city|নদী|পর্বত"),
    ("one_fact_recall", r"(^|[^\p{L}\p{N}_])((who|what|when|কখন)([^\p{L}\p{N}_]|$)|(কে|কী)[\p{L}\p{N}_])"),
)
OPTION_KEYS = ("ক", "খ", "গ", "ঘ")
