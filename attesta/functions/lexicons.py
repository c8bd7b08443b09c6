"""Word lists, markers and thresholds of the style and language rules."""

# fixed values
CJK = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"
WORD = "[0-9A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+(?:['’\\-][0-9A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+)*"

# fixed values: stop words that tell German from English
STOP_DE = ["der", "die", "das", "und", "nicht", "ist", "ein", "eine", "mit", "für", "auf", "werden", "wird"]
STOP_EN = ["the", "and", "of", "to", "is", "that", "for", "with", "was", "are", "this", "not"]

# fixed values: catalogue terms by language
WORDS_EN = [
    "additionally", "moreover", "furthermore", "boast", "breathtaking", "comprehensive", "crucial", "cutting-edge", "delve", "elevate", "embark", "enduring", "enhance", "exemplify", "foster", "game-changing", "garner",
    "groundbreaking", "holistic", "interplay", "intricacy", "intricate", "intuitive", "leverage", "myriad", "nestle", "pivotal", "realm", "renowned", "robust", "seamless", "showcase", "streamline", "stunning",
    "tapestry", "testament", "underscore", "vibrant",
]
PHRASES_EN = [
    "it's worth noting", "it is worth noting", "it's important to note", "it is important to note", "in conclusion", "in summary", "to sum up", "not only", "plays a crucial role", "stands as", "serves as",
    "ever-evolving", "indelible mark", "reflects broader", "must-visit", "everything from", "underscores its importance", "highlights its importance", "several sources", "several publications",
    "in today's", "fast-paced world", "in an era where", "have you ever wondered", "imagine a world where", "picture this", "since the dawn of", "throughout history", "in recent years,",
    "sets the stage", "setting the stage for", "marks a shift", "future looks bright", "exciting times lie ahead", "looking ahead", "only time will tell", "it remains to be seen",
    "journey toward excellence", "the biggest lesson i learned", "this experience taught me", "industry reports", "observers have cited", "experts argue", "experts believe", "some critics argue", "commitment to",
    "despite these challenges", "challenges and legacy", "future outlook", "let me break this down", "let me walk you through", "here's the thing", "the real question is", "what most people get wrong",
    "here's what nobody tells you", "the part everyone misses", "what if i told you", "the short answer is", "so here's what happened", "what struck me most", "i find it fascinating that", "i hope this helps",
    "you're absolutely right", "would you like me", "certainly!", "of course!", "while specific details are limited", "up to my last training update",
]
WATCH_EN = [
    "align", "collaboration", "contributing", "emphasizing", "ensuring", "establishment", "examination", "facilitation", "highlight", "implementation", "journey", "key", "landscape", "navigate",
    "optimization", "powerful", "profound", "reflecting", "rich", "symbolizing", "transformation", "ultimately", "unlock", "utilization", "valuable",
]
WORDS_DE = [
    "zudem", "folglich", "nichtsdestotrotz", "zusammenfassend", "abschließend", "infolgedessen", "innovativ", "nahtlos", "ganzheitlich", "bahnbrechend", "facettenreich", "maßgeblich", "essenziell",
    "meilenstein", "umfassend", "eintauch", "unterstreich", "vielfältig", "atemberaubend", "renommiert", "tiefgreifend", "zusätzlich",
]
PHRASES_DE = [
    "darüber hinaus", "in der heutigen zeit", "im digitalen zeitalter", "es ist wichtig zu beachten", "tauchen wir ein", "eine vielzahl", "breite palette", "nicht nur", "schlüsselrolle", "lässt sich sagen",
    "auf ein neues level", "es lässt sich nicht leugnen", "seit jeher", "in einer welt, in der", "bleibt festzuhalten", "insgesamt zeigt sich", "es bleibt spannend", "die zukunft wird zeigen",
    "was die meisten übersehen", "die eigentliche frage ist", "lassen sie uns eintauchen", "hier ist eine aufschlüsselung", "das sagt dir niemand", "was die meisten falsch machen",
    "immer mehr menschen fragen sich", "fazit:", "dient als", "steht für", "eingebettet in", "spiegelt breitere trends wider", "ist ein beweis", "ist ein zeugnis", "bis hin zu", "angefangen bei",
]
WATCH_DE = ["effizient", "entscheidend", "ermöglich", "landschaft", "lebendig", "markiert", "präzise", "spannend", "zentral"]

# fixed values: contractions and their full forms
CONTRACTIONS = ["don't", "it's", "can't", "won't", "isn't", "we're", "i'm", "didn't", "doesn't", "you're", "that's", "there's", "wasn't", "aren't", "couldn't", "wouldn't", "they're", "we've", "i've", "let's", "he's", "she's", "hasn't", "haven't"]
FULL_FORMS = ["do not", "it is", "cannot", "can not", "will not", "is not", "we are", "i am", "did not", "does not", "you are", "that is", "there is", "was not", "are not", "could not", "would not", "they are", "we have", "i have", "let us", "has not", "have not"]
MODAL_PARTICLES_DE = ["doch", "halt", "mal", "eben", "ja", "schon", "wohl", "eigentlich", "übrigens"]

# fixed values: markers of Cantonese grammar and the standard compounds that hold the same characters
CANTONESE = ["係", "唔", "嘅", "咗", "喺", "啲", "嘢", "佢", "乜", "點解", "而家", "仲", "喐", "冇", "梗係", "睇"]
CANTONESE_EXCEPTIONS = {
    "係": ["關係", "係數", "干係", "幹係", "係屬", "係爭", "純係", "確係", "實係"],
    "仲": ["仲裁", "仲介", "仲夏", "仲春", "仲秋", "仲冬", "伯仲", "昆仲", "仲尼"],
    "而家": ["然而家"],
    "點解": ["重點解", "觀點解", "論點解", "焦點解", "要點解", "難點解", "特點解", "優點解", "缺點解", "地點解"],
}

# fixed values: abbreviations whose stop ends no sentence, always or unless a capital follows
TITLES = {"en": ["mr", "mrs", "ms", "dr", "prof", "rev", "hon", "sr", "jr", "st", "fig", "vol", "no", "dept", "approx"], "de": ["dr", "prof", "hr", "fr", "st", "nr", "abb", "bd", "ca"]}
ABBREVIATIONS = {
    "en": ["vs", "etc", "e.g", "i.e", "cf", "al", "inc", "ltd", "co", "corp", "est", "min", "max", "a.m", "p.m", "ph.d", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun"],
    "de": ["z.b", "u.a", "d.h", "bzw", "evtl", "ggf", "inkl", "exkl", "vgl", "usw", "etc", "mio", "mrd", "jh", "bspw", "allg", "engl", "dt", "s.o", "s.u", "o.g", "jan", "feb", "mär", "apr", "jun", "jul", "aug", "sep", "okt", "nov", "dez"],
}

# fixed values: public suffixes of two labels
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "net.uk", "sch.uk", "co.jp", "ne.jp", "or.jp", "go.jp", "ac.jp", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.au", "net.au", "org.au", "gov.au", "edu.au",
    "com.hk", "org.hk", "gov.hk", "edu.hk", "com.tw", "org.tw", "gov.tw", "com.sg", "com.br", "com.mx", "com.tr", "com.ar", "co.in", "co.kr", "co.nz", "co.za", "co.il",
    "github.io", "gitlab.io", "readthedocs.io", "substack.com", "medium.com", "wordpress.com", "blogspot.com",
]
