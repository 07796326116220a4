"""Words by the default rules of Unicode's text segmentation, as one regular expression.

Letters, digits and what joins them (underscores and the like) run on; an apostrophe, a full stop or a colon between letters,
and a comma, a full stop or an apostrophe between digits, belong to the word; marks and invisible formats stay with what they
follow. Katakana forms words of its own. Scripts without spaces have no dictionary here: each of their letters is a word.
Hebrew's quotation marks within words and enclosed letters aren't covered.
"""

from __future__ import annotations

# Fixed values, as the Unicode standard lists them: what may stand between letters, between digits, and either.
MID_LETTER = r":\x{B7}\x{387}\x{55F}\x{5F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
MID_NUMBER = r",;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}"
MID_EITHER = r".\x27\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
#: Formats and modifiers that stay with what they follow, besides marks.
FORMATS = r"\x{AD}\x{61C}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FF9E}\x{FF9F}\x{1F3FB}-\x{1F3FF}"
#: Letters of scripts whose words aren't parted by spaces: Han, Hiragana, Thai, Lao, Khmer and Myanmar; and those of Katakana.
UNSPACED = (
    r"\x{2E80}-\x{2FD5}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
    r"\x{3041}-\x{3096}\x{309D}-\x{309F}\x{E01}-\x{E30}\x{E32}\x{E33}\x{E40}-\x{E46}\x{E81}-\x{EB0}\x{EB2}\x{EB3}\x{EBD}\x{EC0}-\x{EC6}\x{EDC}-\x{EDF}"
    r"\x{1780}-\x{17B3}\x{17D7}\x{17DC}\x{1000}-\x{102A}\x{103F}\x{1050}-\x{1055}\x{105A}-\x{105D}\x{1061}\x{1065}\x{1066}\x{106E}-\x{1070}\x{1075}-\x{1081}\x{108E}"
)
KATAKANA = r"\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{32D0}-\x{32FE}\x{3300}-\x{3357}\x{FF66}-\x{FF9D}"
#: Latin letters, which are tried first.
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
# End of the fixed values.


def _pattern(one_of, once: str) -> str:
    """one_of: a class or group of several classes; once: the mark of a loop that gives nothing back."""
    letter = [f"[{LATIN}]", rf"[^\P{{L}}{UNSPACED}{KATAKANA}\x{{FF9E}}\x{{FF9F}}]", rf"[^\P{{Nl}}{UNSPACED}]"]
    stays, digit, joins = [r"[\p{M}" + FORMATS + "]"], [r"\p{Nd}"], [r"[\p{Pc}\x{202F}]"]
    run = lambda of: f"{one_of(of)}{one_of([*of, *stays])}*{once}"
    after = f"{one_of(stays)}*{once}"
    letters = f"{run(letter)}(?:[{MID_LETTER}{MID_EITHER}]{after}{run(letter)})*{once}"
    digits = f"{run(digit)}(?:[{MID_NUMBER}{MID_EITHER}]{after}{run(digit)})*{once}"
    block = f"(?:(?:{letters}|{digits})+{once}|{run([f'[{KATAKANA}]'])})"
    return f"(?:{run(joins)})?{block}(?:{run(joins)}{block})*{once}(?:{run(joins)})?|{run(joins)}|[{UNSPACED}]{after}"


#: For DuckDB.
WORD_DUCK = _pattern(lambda of: of[0] if len(of) == 1 else f"(?:{'|'.join(of)})", "")
_MORE = r"\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}\x{202F}" + FORMATS + MID_LETTER + MID_NUMBER + MID_EITHER
# Most words are a run of Latin letters with nothing behind it that could go on; the other rules needn't be tried for these.
_JAVA = f"[{LATIN}]++(?![{_MORE}])|" + _pattern(lambda of: of[0] if len(of) == 1 else f"[{''.join(of)}]", "+")
#: For use within a SQL string of Spark. Loops give nothing back, so that long words need no stack.
WORD = _JAVA.replace("\\", "\\\\")
