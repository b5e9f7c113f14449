"""Fixed values.

Everything in this module is a constant that must stay exactly as written for
results to agree with the reference behaviour and with the DuckDB oracle SQL.
All regular expressions are written so that Java (Spark) and RE2 (DuckDB) read
them the same way: no look-around, no back-references, Unicode classes only.
"""

# --- fixed values: special tokens, in id order 0..4 -------------------------
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>"]
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
MASK_ID = 4

# --- fixed values: compound splitting and the dictionary ---------------------
DEFAULT_INTERFIXES = ["e", "n", "s"]
NOUN_TYPES = ["sb.", "talord", "sb. pl."]
BANNED_WORDS = ["ren", "ger"]
HOMOGRAPH_NUMBER = r"[0-9]+[.] "

# --- fixed values: training and evaluation settings --------------------------
VOCAB_SIZE = 50_000
TRAIN_SIZE = 0.99
SPLIT_SEED = 4242
SEQUENCE_LENGTHS = (128, 512)
DEFAULT_MAX_LENGTH = 512
MLM_PROBABILITY = 0.15
MLM_MASK_SHARE = 0.8      # of the selected positions: replaced by <mask>
MLM_RANDOM_SHARE = 0.1    # of the selected positions: replaced by a random id
IGNORE_INDEX = -100
EVAL_BATCH_SIZE = 8

# --- regular expressions -----------------------------------------------------
# Line breaks as Python text mode reads them.
LINE_BREAK = r"\r\n|\r|\n"
# A line made of white space only.
BLANK_LINE = r"^\s*$"
# Sentence boundary: end punctuation, optional closing quotes or brackets,
# blanks, then an upper-case letter or an opening mark.  Replaced by
# "<group 1>\n<group 2>".
SENTENCE_BOUNDARY = r'([.!?]+["»)\]]*)[ \t]+(\p{Lu}|[¿¡«"(])'
# The same boundary with its blanks kept, replaced by "<1><2>\n<3>".
SENTENCE_GAP = r'([.!?]+["»)\]]*)([ \t]+)(\p{Lu}|[¿¡«"(])'
# A word with inner stops and, if it has one, its full stop; a stop after which
# the sentence goes on is marked by \x01 first.
STOP_INSIDE = r"\.([ \t]+\p{Ll}|[ \t]*,)"
STOPPED_WORD = r"\p{L}+(?:\.\p{L}+)*(?:\.\x01?)?"
STOP_TAIL = r"\.\x01?$"
LAST_STOPPED_WORD = r"(?:^|[^\p{L}.])(\p{L}+(?:\.\p{L}+)*)\.[ \t]*$"
# Word characters of the whitespace pre-tokeniser (Unicode \w).
WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
# White space as the pre-tokeniser sees it (Unicode White_Space).
SPACE_CLASS = r"\p{Z}\t\n\x0B\f\r\x85"
# A pre-token: a run of word characters, or a run of other non-space characters.
TOKEN = "[" + WORD_CLASS + "]+|[^" + WORD_CLASS + SPACE_CLASS + "]+"
# Characters that NFKC leaves as they are, alone and next to any other: ranges
# that hold most text.  A line with any other character is sent through NFKC.
NFKC_STABLE = (r"\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148"
               r"\u014A-\u017E\u0386\u0388-\u038A\u038C\u038E-\u03A1\u03A3-\u03CE\u0400-\u0482\u048A-\u052F"
               r"\u2010\u2012-\u2016\u2018-\u2023\u20AC\u4E00-\u9FFF")
NFKC_CHANGES = "[^" + NFKC_STABLE + "]"
# Special tokens are matched before anything else in raw text.
SPECIAL_TOKEN = "|".join(SPECIAL_TOKENS)
TOKEN_WITH_SPECIALS = SPECIAL_TOKEN + "|" + TOKEN
# Letters only (used to derive the test lexicon from the German documents).
LETTER_RUN = r"\p{L}+"

# --- HTML to text (in this order) ---------------------------------------------
# Blocks without text, each up to the end tag of its own name; script and style
# first, as their content may look like tags.
HTML_DROP_BLOCKS = [rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "nav", "head")]
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_BREAKS = r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|td|th|article|section|header|footer|ul|ol|table|title|blockquote|pre)\s*>"
HTML_TAG = r"<[^>]*>"
# An entity's name at the start of what follows a "&".
HTML_ENTITY_HEAD = r"^(#?[0-9A-Za-z]{1,31});"
# Names of the basic entities, of the Latin-1 letters and of
# common punctuation, in the order of their characters.
_LATIN1_ENTITIES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro "
    "para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil "
    "Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave "
    "Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml "
    "igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute "
    "thorn yuml").split()
HTML_ENTITIES = ([("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")]
                 + [(name, " " if name == "nbsp" else chr(0xA0 + i)) for i, name in enumerate(_LATIN1_ENTITIES)]
                 + [("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("sbquo", "\u201a"),
                    ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("bdquo", "\u201e"), ("bull", "\u2022"), ("hellip", "\u2026"),
                    ("lsaquo", "\u2039"), ("rsaquo", "\u203a"), ("euro", "\u20ac"), ("trade", "\u2122")])
BLANK_RUN = r"[ \t\f\x0B]+"

# --- wiki markup to text (in this order; nested brackets in wikitext.py) -------
WIKI_COMMENT = HTML_COMMENT
WIKI_EMPTY_BLOCKS = r"(?i)<(ref|references|gallery|math)\b[^<>]*/>"
WIKI_DROP_BLOCKS = [rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in (
    "ref", "references", "gallery", "math", "timeline", "syntaxhighlight", "source", "imagemap")]
# Namespaces whose links show nothing in running text, in English,
# Danish, Swedish, Norwegian, Icelandic, Faroese and German.
WIKI_DROP_NAMESPACES = ("file", "image", "category", "fil", "billede", "kategori", "bild", "mynd", "flokkur",
                        "bólkur", "datei", "kategorie")
# [http://target label]
WIKI_EXTERNAL = r"\[(?:[A-Za-z]+:)?//[^ \t\]\n]*[ \t]*([^\]\n]*)\]"
WIKI_HEADING = r"(?m)^={1,6}[ \t]*(.*?)[ \t]*={1,6}[ \t]*$"
WIKI_EMPHASIS = r"'{2,}"
WIKI_SWITCH = r"__[A-Z]+__"
WIKI_LIST = r"(?m)^[*#:;]+[ \t]*"

# --- hash draws ---------------------------------------------------------------
# A draw is the first 6 hex digits of an md5 as an integer in [0, 2^24).
DRAW_HEX_DIGITS = 6
DRAW_RANGE = 16 ** DRAW_HEX_DIGITS
