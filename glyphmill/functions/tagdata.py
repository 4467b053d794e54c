"""Values of the issue tags of tokens: what each tag says, the characters it stands for, patterns of words.

All of this is fixed: reports of both analyzers can only be compared if tags, texts and ranges are the same.
"""

from __future__ import annotations

# Tags in the order of the report, and what they say.
TAGS: dict[str, str] = dict(
    line.strip().split(": ", 1)
    for line in """
    NON_UTF8: Token does not conform to UTF-8
    UTF8_NON_SHORTEST: Token does not conform to UTF-8 (character is not rendered in shortest form)
    CONTROL_CHAR: Token contains control character
    VARIATION_SELECTOR: Token contains variation selector, used to specify specific glyph variants for Unicode characters (highly unusual)
    REPL_OBJECT: Token contains replacement object
    REPL_CHAR: Token contains replacement character
    OTHER_CHAR: Token contains character of unknown script (possibly junk)
    PRIVATE_USE: Token contains private use area character (undefined)
    INITIAL_BYTE_ORDER_MARK: Token contains sentence-initial byte-order-mark (often used to mark text as UTF8)
    ZERO_WIDTH: Token contains zero-width character, incl. byte-order, direction and join marks
    IPA: Token contains IPA extension/modifier letter (International Phonetic Alphabet)
    MODIFIER_TONE: Token contains modifier tone letter
    COMBINING_DIACRITIC: Token contains combining diacritic
    NON_ASCII_PUNCT_CHAR: Character is non-ASCII punctuation
    NON_ASCII_PUNCT: Token contains non-ASCII punctuation
    NON_ASCII_WHITESPACE_CHAR: Character is non-ASCII whitespace
    NON_ASCII_WHITESPACE: Token contains non-ASCII whitespace
    GEOMETRIC_SHAPE_CHAR: Character is geometric shape, incl. circles and squares
    GEOMETRIC_SHAPE: Token contains geometric shape, incl. circles and squares
    LETTERLIKE_SYMBOL_CHAR: Character is letterlike symbol
    LETTERLIKE_SYMBOL: Token contains letterlike symbol
    MATH_ALPHA_SYMBOL: Token contains mathematical alphanumeric symbol
    TECHNICAL_SYMBOL_CHAR: Character is technical symbol
    TECHNICAL_SYMBOL: Token contains technical symbol
    MATHEMATICAL_OPERATOR_CHAR: Character is mathematical operator
    MATHEMATICAL_OPERATOR: Token contains mathematical operator
    ARROW_SYMBOL_CHAR: Character is arrow symbol
    ARROW_SYMBOL: Token contains arrow symbol
    MISC_SYMBOL_CHAR: Character is miscellaneous symbol
    MISC_SYMBOL: Token contains miscellaneous symbol
    TAG_CHAR: Character is tag
    TAG: Token contains tag
    BOX_DRAWING: Token contains box drawing element
    CURRENCY: Token contains currency symbol
    ASCII_LETTER: Token contains ASCII alphabetic character
    LANGUAGE_SPECIFIC: Token contains extended alphabetic character typical for specified language
    LATIN_PLUS_ALPHA: Token contains Latin-Plus alphabetic character
    LATIN_EXTENDED: Token contains Extended-Latin character
    LATIN_EXTENDED_ADD: Token contains Additional-Extended-Latin character
    LATIN_TYPOGRAPHIC_LIGATURE: Token contains typographic Latin ligature (deprecated)
    LATIN_EXTENDED_LIGATURE: Token contains Latin ligature, as found in Dutch (ij) and French (oe)
    FULL_WIDTH: Token contains full-width (Latin) character
    ARABIC_LETTER: Token contains standard Arabic alphabetic character
    ARABIC_DIGIT: Token contains Arabic digit
    ARABIC_INDIC_DIGIT: Token contains extended Arabic-Indic digit
    ARABIC_TATWEEL: Token contains Arabic tatweel (elongation character)
    ARABIC_PUNCT: Token contains Arabic punctuation
    ARABIC_NON_STANDARD: Token contains non-standard Arabic character
    ARABIC_PRESENTATION: Token contains Arabic character in presentation form
    ARABIC_PREFIX_ASCII: Token contains Arabic prefix plus ASCII digits/Latin letters
    MIXED_ARABIC_ASCII: Token contains mix of Arabic and ASCII
    ARABIC_LETTER_YEH: Token contains the Arabic version of the letter yeh
    FARSI_LETTER_YEH: Token contains the Farsi version of the letter yeh
    ARABIC_LETTER_KAF: Token contains the Arabic letter kaf
    FARSI_LETTER_KEHEF: Token contains the Farsi letter keheh (the Farsi variant of Arabic letter kaf)
    ARMENIAN: Token contains Armenian character
    BENGALI: Token contains Bengali character
    BOPOMOFO: Token contains Bopomofo character (for Chinese/Mandarin pronunciation)
    BUGINESE: Token contains Buginese character
    CANADIAN_SYLLABIC: Token contains Canadian Aboriginal Syllabic
    CHEROKEE: Token contains Cherokee character (Native American)
    CJK: Token contains CJK character (Chinese, Japanese kanji)
    CJK_EXTENDED: Token contains CJK extended character (Chinese, Japanese kanji)
    CJK_SQ_LATIN_ABBREV: Token contains CJK compatible squared Latin abbreviation character
    MIXED_CJK_ASCII: Token contains mix of CJK and ASCII
    COPTIC: Token contains Coptic character (Egypt)
    CUNEIFORM: Token contains Cuneiform character (Ancient Mesopotamia)
    CYRILLIC: Token contains Cyrillic character
    CYRILLIC_EXTENDED: Token contains Cyrillic extended character
    MIXED_CYRILLIC_LATIN: Token contains mix of Cyrillic and Latin
    PUNCT_CYRILLIC: Token contains punctuation followed by Cyrillic
    CYRILLIC_PUNCT: Token contains Cyrillic followed by punctuation
    MIXED_CYRILLIC_PUNCT: Token contains mix of Cyrillic and Punctuation
    CYRILLIC_PLUS_PERIOD: Token contains Cyrillic and a period (possibly abbreviation)
    DEVANAGARI: Token contains Devanagari character (Indian languages)
    STD_SEP_NUKTA: Token contains separate Nukta character, standard (Devanagari)
    ALT_SEP_NUKTA: Token contains separate Nukta character, non-standard encoding, should be composed (Devanagari)
    STD_CMP_NUKTA: Token contains composed character with Nukta, standard encoding (Devanagari)
    ALT_CMP_NUKTA: Token contains composed character with Nukta, non-standard encoding, should be decomposed (Devanagari)
    DIS_VSGN_NUKTA: Token contains vowel-sign followed by Nukta, non-standard order (Devanagari)
    EGYPTIAN_HIEROGLYPH: Token contains Egyptian hieroglyph
    ENCLOSED_ALPHANUMERIC: Token contains Enclosed alphanumeric character
    ETHIOPIC: Token contains Ethiopic character
    ETHIOPIC_PUNCT: Token contains Ethiopic punctuation
    GEORGIAN_STANDARD: Token contains standard Georgian character
    GEORGIAN_ARCHAIC: Token contains archaic Georgian character in standard script
    GEORGIAN_EMPHASIS: Token contains Georgian character in non-standard Mkhedruli Mtavruli script (emphasis)
    GEORGIAN_ASOMTAVRULI: Token contains Georgian character in historic Asomtavruli script
    GEORGIAN_NUSHKHURI: Token contains Georgian character in historic Nuskhuri script
    PUNCT_GEORGIAN: Token contains punctuation followed by Georgian
    GEORGIAN_PUNCT: Token contains Georgian followed by punctuation
    MIXED_GEORGIAN_PUNCT: Token contains mix of Georgian and Punctuation
    GEORGIAN_PLUS_PERIOD: Token contains Georgian and a period (possibly abbreviation)
    GOTHIC: Token contains Gothic character
    GREEK: Token contains Greek character
    GREEK_EXTENDED: Token contains Extended-Greek character
    GUJARATI: Token contains Gujarati character (India)
    GURMUKHI: Token contains Gurmukhi character (used for Punjabi, India)
    HEBREW: Token contains Hebrew character
    JAPANESE_KANA: Token contains Japanese Hiragana/Katakana character
    JAPANESE_PUNCT: Token contains Japanese punctuation
    JAVANESE: Token contains Javanese character (Indonesia)
    KANNADA: Token contains Kannada character (India)
    KHMER: Token contains Khmer character
    KLINGON: Token contains Klingon character (pIqaD, ConScript registry)
    KOREAN_HANGUL: Token contains Korean Hangul character
    LAO: Token contains Lao character
    LISU: Token contains Lisu character (Burma, China, Thailand, India)
    MALAYALAM: Token contains Malayalam character (India)
    MEETAI_MAYEK: Token contains Meetai Mayek character (India)
    MONGOLIAN: Token contains Mongolian character
    MYANMAR: Token contains Myanmar/Burmese character
    OGHAM: Token contains Ogham character (ancient Irish script)
    ORIYA: Token contains Oriya/Odia character (India)
    PHOENICIAN: Token contains Phoenician character (Ancient Levant, Punic of Carthage)
    PICTOGRAPH: Token contains pictograph (incl. dingbat, emoji)
    RUNIC: Token contains Runic character
    SINHALA: Token contains Sinhala character (Sri Lanka)
    SUNDANESE: Token contains Sundanese character (Indonesia)
    SYRIAC_LETTER: Token contains Syriac letter
    SYRIAC_PUNCT: Token contains Syriac punctuation
    SYRIAC_DIACRITIC: Token contains Syriac diacritic, incl. points and marks
    TAMIL: Token contains Tamil character (India, Sri Lanka)
    TELUGU: Token contains Telugu character (Indai)
    THAANA: Token contains Thaana character (Maldives)
    THAI: Token contains Thai character
    TIBETAN_PUNCT: Token contains Tibetan punctuation
    TIBETAN: Token contains Tibetan character
    TIFINAGH: Token contains Tifinagh character (Morocco)
    YI_SYLLABLE: Token contains Yi syllable (China, Vietnam, Thailand)
    BROKEN_EMAIL: Broken email address
    BROKEN_URL: Broken URL
    SUSPICIOUS_URL: Suspicious URL (ill-formed)
    BROKEN_FILENAME: Broken filename
    BROKEN_EMAIL_FUZZY: Broken email address (fuzzy)
    BROKEN_URL_FUZZY: Broken URL (fuzzy)
    UNUSUAL_PUNCT_COMB: Unusual combination of punctuation
    SPLIT_XML: Split XML token
    XML_ESC_DEC: XML escape character, decimal
    XML_ESC_HEX: XML escape character, hexadecimal
    XML_ESC_STD: XML escape character, standard
    XML_ESC_ABC: XML escape character, alphabetic
    UNSPLIT_PUNCT_ALPHA_HYPHEN: Unsplit punctuation alpha+hyphen
    UNSPLIT_PUNCT: Unsplit punctuation
    UNSPLIT_APO_S: Unsplit 's
    UNSPLIT_APO_V: Unsplit 'd/'ll/'m/'ve
    UNSPLIT_NOT: Unsplit n't/not
    UNSPLIT_PERIOD: Unsplit period, comma etc.
    NUM_UNSPLIT_PERIOD: Unsplit number+period
    BEN_UNSPLIT_APO: Unsplit apostrophe appearing to be benign
    BEN_UNSPLIT_PERIOD: Unsplit period, comma etc. appearing to be benign
    BEN_UNSPLIT_PUNCT: Unsplit punctuation appearing to be benign
    HASHTAG: Hashtag
    HANDLE: Handle
    URL: URL
    EMAIL: Email
    LONG_TOKEN_20: Long token ({long_min}-29 characters)
    LONG_TOKEN_30: Very long token (30+ characters)
    """.strip().splitlines()
)

# The characters of a tag beyond ASCII, as hexadecimal ranges; of tags that share a character the earlier stands.
RANGES = """
    CONTROL_CHAR 80-9F
    CURRENCY A2-A5 20A0-20BF
    NON_ASCII_WHITESPACE A0 2000-200A 202F 205F 3000
    ZERO_WIDTH 200B-200F 202A-202E FEFF
    LATIN_EXTENDED_LIGATURE 132-133 152-153
    LATIN_EXTENDED 100-24F
    IPA 250-2FF 1D00-1DBF
    COMBINING_DIACRITIC 300-36F
    GREEK 370-3E1
    COPTIC 3E2-3EF 2C80-2CFF
    CYRILLIC 400-52F
    ARMENIAN 530-58F
    HEBREW 590-5FF
    ARABIC_TATWEEL 640
    ARABIC_LETTER 621-63A 641-64A
    ARABIC_DIGIT 660-669
    ARABIC_PUNCT 60C-60D 61B 61F 66A-66D
    ARABIC_INDIC_DIGIT 6F0-6F9
    ARABIC_NON_STANDARD 600-6FF
    SYRIAC_PUNCT 700-70F
    SYRIAC_LETTER 710-72F
    SYRIAC_DIACRITIC 730-74A
    THAANA 780-7BF
    DEVANAGARI 900-97F
    BENGALI 980-9FF
    GURMUKHI A00-A7F
    GUJARATI A80-AFF
    ORIYA B00-B7F
    TAMIL B80-BFF
    TELUGU C00-C7F
    KANNADA C80-CFF
    MALAYALAM D00-D7F
    SINHALA D80-DFF
    THAI E00-E7F
    LAO E80-EFF
    TIBETAN_PUNCT F01-F14 F34-F3D F84-F85
    TIBETAN F00-FFF
    MYANMAR 1000-109F
    GEORGIAN_ASOMTAVRULI 10A0-10CF
    GEORGIAN_ARCHAIC 10F1-10F5
    GEORGIAN_STANDARD 10D0-10FF
    KOREAN_HANGUL 1100-11FF AC00-D7BF
    ETHIOPIC_PUNCT 1360-1368
    ETHIOPIC 1200-137F
    CHEROKEE 13A0-13FF
    CANADIAN_SYLLABIC 1400-167F
    OGHAM 1680-169F
    RUNIC 16A0-16FF
    KHMER 1780-17FF
    MONGOLIAN 1800-18AF
    BUGINESE 1A00-1A1F
    SUNDANESE 1B80-1BBF
    CYRILLIC_EXTENDED 1C80-1C8F 2DE0-2DFF A640-A69F
    GEORGIAN_EMPHASIS 1C90-1CBF
    LATIN_EXTENDED_ADD 1E00-1EFF
    GREEK_EXTENDED 1F00-1FFF
    LETTERLIKE_SYMBOL 2100-214F
    ARROW_SYMBOL 2190-21FF 2B00-2B11 2B30-2B4F 2B5A-2BB9
    MATHEMATICAL_OPERATOR 2200-22FF
    TECHNICAL_SYMBOL 2300-23FF
    ENCLOSED_ALPHANUMERIC 2460-24FF 1F100-1F1FF
    BOX_DRAWING 2500-257F
    GEOMETRIC_SHAPE 25A0-25FF 2B12-2B2F 2B50-2B59 2BBA-2BC8 2BCA-2BCF 1F780-1F7FF
    PICTOGRAPH 2600-27BF 1F300-1F6FF 1F900-1FAFF
    MISC_SYMBOL 2B00-2BFF 3200-32FF 1F000-1F0FF 1F200-1F2FF
    NON_ASCII_PUNCT A0-BF D7 F7 2000-2BFF 3001-3011 3014-301F 3030 303B-303D FE10-FE19 FE30-FE6B FF5B-FF64 1F800-1F8FF
    LATIN_PLUS_ALPHA C0-FF
    GEORGIAN_NUSHKHURI 2D00-2D2F
    TIFINAGH 2D30-2D7F
    JAPANESE_PUNCT 30FB
    JAPANESE_KANA 3040-30FF
    BOPOMOFO 3100-312F
    CJK_SQ_LATIN_ABBREV 3371-337A 3380-33DF 33FF
    CJK 4E00-9FFF
    YI_SYLLABLE A000-A4BF
    LISU A4D0-A4FF
    MODIFIER_TONE A700-A71F
    JAVANESE A980-A9DF
    MEETAI_MAYEK ABC0-ABFF
    KLINGON F8D0-F8FF
    PRIVATE_USE E000-F8FF F0000-10FFFF
    LATIN_TYPOGRAPHIC_LIGATURE FB00-FB06
    ARABIC_PRESENTATION FB50-FDFF FE70-FEFC
    VARIATION_SELECTOR FE00-FE0F E0100-E01FF
    FULL_WIDTH FF01-FF5A FFF0-FFF6
    REPL_OBJECT FFFC
    REPL_CHAR FFFD
    GOTHIC 10330-1034F
    PHOENICIAN 10900-1091F
    CUNEIFORM 12000-123FF
    EGYPTIAN_HIEROGLYPH 13000-1343F
    MATH_ALPHA_SYMBOL 1D400-1D7FF
    CJK_EXTENDED 20000-2AFFF
    TAG E0000-E007F
"""
# Tags whose characters are also counted one by one, and characters of these tags that are not.
BY_CHARACTER = ("NON_ASCII_PUNCT", "NON_ASCII_WHITESPACE", "GEOMETRIC_SHAPE", "LETTERLIKE_SYMBOL", "MATHEMATICAL_OPERATOR", "TECHNICAL_SYMBOL", "ARROW_SYMBOL", "MISC_SYMBOL", "TAG")
NOT_BY_CHARACTER = "[\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{1F800}-\\x{1F8FF}]"
# Single letters with a tag besides that of their range.
LETTERS = {"ي": "ARABIC_LETTER_YEH", "ی": "FARSI_LETTER_YEH", "ك": "ARABIC_LETTER_KAF", "ک": "FARSI_LETTER_KEHEF"}
# Letters that are usual in a language.
USUAL = {
    ("de", "ger"): "ÄÖÜßäöü",
    ("es", "spa"): "ÁÉÍÏÑÓÚáéíïñóú",
    ("fr", "fre"): "ÀÂÇÈÉÊËÎÏÔÙÛàâçèéêëîïôùûŒœ",
    ("ur", "urd"): "ًٱٹپچڈڑژگںہۂیےۓ",
}
# Tags whose examples are not shown for a language.
NORMAL = {
    "ARABIC_LETTER": "ar ara dar far ur urd",
    "ARABIC_NON_STANDARD": "dar far ur urd",
    "ASCII_LETTER": "de en eng es fr fre ger kin mlg som spa",
    "CJK": "chi jp zh",
    "CYRILLIC": "ru",
    "GREEK": "gr",
    "JAPANESE_KANA": "jp",
}
LANGUAGES = "ar ara chi dar de en eng es far fr fre gr jp kin mlg ru som ur zh".split()
# Parts of patterns.
TITLES = "Adm|Amb|al|Brig|Capt|Co|Col|Cpt|Dj|Dr|Eng|Fr|Ft|Gen|Gov|Hon|Inc|Ing|Inj|Ir|Jen|Jr|Lt|Maj|Mr|Mrs|Ms|Mt|no|Pres|Pr|Prof|Rep|Rev|Rév|Sen|Sgt|Spt|Sr|St|Sup|Supt|vol|Vol"
BIBLE = "Dan|Deo|Eks|Gen|Hab|Hag|Hos|Isa|Iza|Jer|Joe|Jos|Lev|Lio|Mal|Mat|Mik|Mpan|Oha|Sal|Sam|Zak"
MONTHS = "Jan|Febr?|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
DOMAINS = "cat|com|edu|gov|info|int|mil|museum|net|org|ar|at|au|be|bi|br|ca|ch|cn|co|cz|de|dk|es|eu|fi|fr|gr|hk|hu|id|ie|il|in|is|it|jp|ke|kr|lu|mg|mx|my|nl|no|nz|pl|pt|ro|ru|rw|se|sg|tr|tv|tw|tz|ug|uk|us|za"
FILES = "cgi|doc|gif|html|htm|jpeg|jpg|pdf|txt|xml"
PREFIXES = "ال|ب|ل|و|وال|بال|لل|وب"
ESCAPES = "amp|lt|gt|quot|apos|nbsp"
CLITICS = "ab|ah|ak|ay|b|bw|by|cy|h|iby|icy|iry|iy|iz|k|kubw|kw|m|muby|mur|mw|n|nab|nd|ng|nk|nt|ny|nyir|rw|ry|s|ubw|ukw|urw|utw|uw|tw|w|y|z"
LONG_WORDS = "compartmentali[sz]ations?|counterrevolutionaries|counterrevolutionary|deinstitutionali[sz]ations?|hydrochlorofluorocarbons?|institutionali[sz]ations?|instrumentali[sz]ations?|internationali[sz]ation|mischaracteri[sz]ations?|transnationali[sz]ation|uncharacteristically"


def ranges() -> list[tuple[int, int, str]]:
    """(first, last, tag), in order of precedence."""
    out = []
    for line in RANGES.strip().splitlines():
        tag, *spans = line.split()
        for s in spans:
            a, _, z = s.partition("-")
            out.append((int(a, 16), int(z or a, 16), tag))
    return out
