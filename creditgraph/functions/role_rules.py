"""The rule tables of role texts."""

# Fixed values, which decide what a role is called: separators, removals, alternative spellings, words for numbers and
# abbreviations, and clean-up patterns, each list in the order in which it is applied.
SEPARATORS = r" & |&|＆| and | And |/|; |\+| - |・| Und | Et "
A_AND_R = r"\b[aA] ?(&|and|And|\+) ?[rR]\b"
BRACKETS = r"[({\[［].*[)}\]］]"
QUOTES = r"\".*\"|\s+'.*'\s+|\s*'.*'$"
OPEN_BRACKET = r"\([^)]*$"
NO_NAME = r"^\d+[-.)]*$|^[-*+.?/!`—•]+$"
ALTERNATIVES = {
    "accordeon": "Accordion", "accordian": "Accordion", "acordeon": "Accordion", "acordeón": "Accordion", "agogo": "Agogô",
    "arranger": "Arranged By", "arrangements": "Arranged By", "art": "Artwork", "bassguitar": "Bass Guitar", "bateria": "Drums",
    "batterie": "Drums", "beat": "Beats", "bodhran": "Bodhrán", "bongo": "Bongos", "cajon": "Cajón", "celeste": "Celesta",
    "cgi": "CGI", "cgi artist": "CGI Artist", "composer": "Composed By", "conducted by": "Conductor", "darbouka": "Darbuka",
    "dj": "DJ", "dj mix": "DJ Mix", "ft": "Featuring", "lyrics": "Lyrics By", "mixed": "Mixed By", "keys": "Keyboards",
    "mix": "Mixed By", "mixer": "Mixed By", "mixing": "Mixed By", "music": "Music By", "programmer": "Programmed By",
    "remiz": "Remix", "remixer": "Remixed By", "rythm": "Rhythm", "singer": "Vocals", "sax": "Saxophone", "synths": "Synthesizers",
    "vocalist": "Vocals", "vocal": "Vocals", "vibes": "Vibraphone", "voices": "Vocals", "vox": "Vocals", "writer": "Written By",
    "writing": "Written By", "words": "Words By",
}
MACHINES = {"303": "TB", "606": "TR", "707": "TR", "808": "TR", "909": "TR"}
STRING_NUMBERS = {20: "Twenty", 10: "Ten", 11: "Eleven", 12: "Twelve", 13: "Thirteen", 17: "Seventeen", 18: "Eighteen", 1: "One", 2: "Two", 3: "Three", 4: "Four", 5: "Five", 6: "Six", 7: "Seven", 8: "Eight", 9: "Nine"}
BIT_NUMBERS = {8: "Eight", 12: "Twelve", 16: "Sixteen", 24: "TwentyFour", 32: "ThirtyTwo"}
STRING_SHORT_FORMS = [
    (r"[- ]+Sting", "-String"), (r"[- ]+Str ", "-String"), (r"[- ]+Str$", "-String Guitar"), (r"[- ]+String-$", "-String Guitar"), (r"[- ]+Stringed-", "-Stringed "),
]
STRING_MACHINES = r"(?i)Roland|Solina|Arp"
STRING_HYPHEN = (r"[- ]+String ", "-String ")
STRING_ENDINGS = [
    (r"[sS]tring-Guitar", "String Guitar"), (r"^(.*-String )*Acoustic$", r"\1Acoustic Guitar"), (r"-Strings", "-String"), (r"\bGuitars\b", "Guitar"),
    (r"^(\d+) *[sS]tring(?: Guitar)?$", r"\1-String Guitar"),
]
STRINGS_LAST = (r"^(.*) \((Six|Twelve)-String\)$", r"\2-String \1")
CAPITALS, NOT_CAPITALS = r"[A-Z]+", ("ANR", "FX")
SMALL_WORDS, SHORT_WORDS = ("By", "To", "At", "With"), ("DJ", "VJ", "CGI")
FIRST_CLEANUP = [(r"\bCo- ", "Co-"), (r"^[A-Z]\d+$", ""), (r"^Track(s)*\sA*\d*-*\d+", "")]
COUNTED = (r"^\d+[^\d-] +(.*)$", r"\1")
LEADING_NUMBER = r"^\d+[ :]+(.*)$"
NUMBERED_TERMS = {"Tone Row": (r"12[- ]", "Twelve-"), "Track Recording": (r"16[- ]", "Sixteen-")}
INITIALS = r"^((?:\S\.){2,4}) *$"
ABBREVIATIONS = [
    (r"\bMus[. ]", "Musicians "), (r"\bArr[. ]", "Arranged "), (r"\bDir[. ]", "Director "), (r"\bFea[. ]", "Featuring "), (r"\bFeat[. ]", "Featuring "), (r"\bTrad[. ]", "Traditional "),
    (r"\bProd[. ]+By", " Produced By"), (r"\bProd[. ]", " Producer "), (r"\bAcc[. ]", "Acoustic "), (r"\bAdd[. ]", "Additional "), (r"\bAssoc[. ]", "Associate "), (r"\bAsst[. ]", "Assistant "),
    (r"\bExec[. ]", "Executive "), (r"\bOrc[. ]", "Orchestral "), (r"\bBck[. ]", "Backing "), (r"\bBkg[. ]", "Backing "), (r"\bBk[. ]", "Backing "), (r"\bMod[. ]", "Moderno "),
    (r"\bMisc([. ]|$)", "Miscellaneous "), (r"(?i)\bFx([. ]|$)", "Effects "), ("作曲", "Composition"), ("編曲", "Arrangement"), ("作詞", "Lyrics"), ("譜本", "Music"),
]
NUMBERS_AND_DATES = [
    (r"^\(\d+[- ]*\d*\)", ""), (r"^\(\d+[- ]*Present\)", ""), (r"^\d\d\d\d[- ]+\d\d\d\d", ""), (r"^\d\d\d\d[- ]+\d\d[- ]\d\d", ""), (r"©\s*\d\d\d\d", ""), (r"℗\s*\d\d\d\d", ""),
    (r"(?i)^1st\s*", ""), (r"(?i)^2nd\s*", ""), (r"(?i)^3rd\s*", ""), (r"(?i)^4th\s*", ""), (r"(?i)^.*Recorded By", "Recorded By"), (r"(?i)^.*Written By", "Written By"),
]
ENDINGS = [
    (r" {2}", " "), (r" , ", ", "), (r"[:`.]+$", ""), (r" Etc$", ""), (r"-$", ""), (r"–$", ""), (r"^\*", ""), (r"\*$", ""), (r";$", ""), (r"\)$", ""), (r"]$", ""), (r"],", ","), (r"] ", " "), (r"\bANR\b", "A&R"),
]
INSTRUMENT_CLASSES = {"idiophones": "Drums & Percussion", "membranophones": "Drums & Percussion", "chordophones": "Stringed Instruments", "aerophones": "Wind Instruments", "electrophones": "Technical Musical"}
OTHER_INSTRUMENTS = "Other Musical"
CUTOFF = 90.0
