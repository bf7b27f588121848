"""Lists of medications typed without separators, taken apart where a new name begins."""

from __future__ import annotations

import re

#: Units of a strength; words of directions, which begin no entry; words looked at for the next strength.
UNITS = r"mcg/hr?|mg|mcg|g|ml|meq|units?|%"
DOSING_WORDS = frozenset(
    "once twice three four times time daily day days a an per every each hours hour hrs hr h q qd bid tid qid qhs prn po as needed necessary "
    "at bedtime night morning evening afternoon in the with without before after food meals meal breakfast lunch dinner supper on those "
    "max maximum up to no more than may repeat not exceed doses dose tablet tablets tab tabs capsule capsules cap caps pill pills patch patches "
    "spray sprays puff puffs drop drops nostril nostrils eye eyes ear ears weekly week weeks continuous episode for and or by mouth orally oral "
    "iv im subcutaneous transdermal sublingual nasal inhaled topical er xr xl sr ir dr cd la ds otc generic x of one two".split()
)
AHEAD = 6

_AMOUNT = re.compile(rf"\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)*(?P<unit>\s*(?:{UNITS})(?:/\w+)?)?", re.I)
_UNIT = re.compile(rf"(?:{UNITS})(?:/\w+)?", re.I)
_NAME = re.compile(r"[A-Za-z][A-Za-z'-]*")


def strengths(words: list[str]) -> list[bool]:
    """Whether a strength begins at each word: 20mg, 20 mg, 10/325 mg, 25 mcg/h."""
    out = []
    for word, after in zip(words, [*words[1:], ""]):
        m = _AMOUNT.fullmatch(word)
        out.append(m is not None and (m["unit"] is not None or _UNIT.fullmatch(after) is not None or (_AMOUNT.fullmatch(after) or {"unit": None})["unit"] is not None))
    return out


def split_run_on(entry: str) -> list[str]:
    """The entries of a text: after a strength, a word that is no direction begins the next one if a strength comes within
    AHEAD words and no equals sign stands between. Blank text gives none."""
    words = entry.split()
    begins = strengths(words)
    cuts, dosed = [0], False
    for i, word in enumerate(words):
        if dosed and _NAME.fullmatch(word.rstrip(",.;:")) and not _UNIT.fullmatch(word) and word.strip("(),.;:").lower() not in DOSING_WORDS:
            near = range(i + 1, min(len(words), i + 1 + AHEAD))
            stop = next((j for j in near if "=" in words[j]), len(words))
            if any(begins[j] for j in near if j < stop):
                cuts.append(i)
                dosed = False
        dosed |= begins[i]
    return [" ".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)]) if words[a:b]]
