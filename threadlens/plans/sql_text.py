"""DuckDB spellings of the Unicode-aware text helpers used by the oracle SQL."""

# Java's (?U)\s is the Unicode White_Space property; RE2's \s is ASCII only, so spell it out.
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}+', ' ', 'g')"

W = r"[\p{L}\p{N}\p{M}_]"  # Python / Java-(?U) word character
NW = r"[^\p{L}\p{N}\p{M}_]"
NONWS = "[^" + WS[1:]
D = r"\p{Nd}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask(x: str) -> str:
    from threadlens.functions.text import LETTERS

    steps = [
        (f"@{W}{{2,}}", "@user"), (f"http{NONWS}+", "URL"),
        (f"([{LETTERS}])({D}+)", r"\1 \2"), (f"({D}+)([{LETTERS}€])", r"\1 \2"),
        (f"({D}+\\.)?{D}+(,{D}+)?", "NUM"), (f"a?j+a+j{W}+", "jaja"), (f"a?h+a+h{W}+", "jaja"),
        ("text+d+", "jaja"), (r"[:;]\)", "jaja"),
    ]
    for pat, rep in steps:
        x = f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, 'g')"
    return x


def drop_short_words(x: str, n: int = 1) -> str:
    for _ in range(3):
        x = f"regexp_replace({x}, {lit(f'(^|{NW}){W}{{1,{n}}}({NW}|$)')}, '\\1\\2', 'g')"
    return x


def strip_punctuation(x: str) -> str:
    from threadlens.functions.text import PUNCTUATION

    chars = PUNCTUATION + "\n\t"
    return f"translate({x}, {lit(chars)}, {lit(' ' * len(chars))})"


def squeeze_spaces(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}{{2,}}', ' ', 'g')"


def squeeze_repeats_chars(ch: str) -> str:
    """k=2 on a character list column: keep a character unless it is the 3rd+ copy in a run
    (newlines are never squeezed, like Python's ``.``)."""
    return (f"array_to_string(list_filter({ch}, lambda x, i: i <= 2 OR NOT ("
            f"x = {ch}[i - 1] AND x = {ch}[i - 2] AND x <> chr(10))), '')")


MARK = ""


def split_hashtags(x: str) -> str:
    marked = f"regexp_replace({x}, {lit(f'(^|{NW})#({W}*[a-zA-Z]{W}*)')}, {lit(chr(92) + '1' + MARK + chr(92) + '2')}, 'g')"
    body = f"regexp_extract(p, {lit('^' + W + '*')})"
    camel = strip(f"regexp_replace({body}, '([A-Z]+)', ' \\1', 'g')")
    rewrite = f"CASE WHEN i = 1 THEN p ELSE 'hashtag ' || {camel} || substr(p, length({body}) + 1) END"
    return f"array_to_string(list_transform(string_split({marked}, {lit(MARK)}), lambda p, i: {rewrite}), '')"


def demojize(x: str, names: dict[str, str]) -> str:
    for k in sorted(names, key=len, reverse=True):
        x = f"replace({x}, {lit(k)}, {lit(f' emoji {names[k]} emoji ')})"
    return f"replace({x}, '_', ' ')"
