"""A reader of amounts and dates in running text.

A text is cut into atoms (a run of digits, a run of letters, a run of spaces, or one mark); readers go
from atom to atom.  Python strings in, Python values out; parse and forms wrap them for Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal
from functools import cache

# fixed values
CURRENCY_WORDS, CURRENCY_SIGN = ["rs", "inr"], "₹"
MULTIPLIERS = {"k": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "l": 100_000, "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000}
MONTHS = "january february march april may june july august september october november december".split()
RANGE_MARKS = ["-", "–", "—", "to"]
START_WORDS = ["from", "starting", "starts", "start", "effective", "since", "wef", "in"]
#: What may stand between such a word and the date.
FILLERS = ["the", "of", "1", "st", "first"]
BEFORE_A_MONTH = ["in", "by", "on", "before", "until"]
#: Relative days, by their words; and what "in 3 ..." counts.
RELATIVE_DAYS = {"tomorrow": 1, "next week": 7, "next month": 30}
UNIT_DAYS = {"day": 1, "days": 1, "week": 7, "weeks": 7}
#: Layouts of a date, as steps: Y M D numbers, YY a year of two digits too, mon a month's name, _ spaces, sep a
#: mark between numbers; a step with ? may be missing.
LAYOUTS = ["Y4 - M2 - D2", "D th? _ mon .? ,? _ Y4", "mon .? _ D th? ,? _ Y4", "D sep M sep YY"]

#: Month by name, in full or by its first three letters (and one by four).
MONTH_NUMBERS = {form: i for i, name in enumerate(MONTHS, 1) for form in (name, name[:3])} | {"sept": 9}
ATOM = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)


def is_number(atom: str) -> bool:
    return atom[:1].isdecimal()


def joins(atom: str) -> bool:
    """Would this atom make one word with a letter or digit beside it?"""
    return atom[:1].isalnum() or atom == "_"


class Atoms:
    def __init__(self, text: str) -> None:
        self.all = ATOM.findall(text)
        self.starts = [0]
        for atom in self.all:
            self.starts.append(self.starts[-1] + len(atom))

    def __getitem__(self, i: int) -> str:
        return self.all[i] if 0 <= i < len(self.all) else ""

    def __len__(self) -> int:
        return len(self.all)

    def after_spaces(self, i: int, step: int = 1) -> int:
        return i + step if self[i].isspace() else i


def is_grouped(groups: list[str]) -> bool:
    """Thousands in threes, or the last three and twos before."""
    sizes = [len(g) for g in groups]
    threes = sizes[0] <= 3 and all(n == 3 for n in sizes[1:])
    twos = sizes[0] <= 2 and sizes[-1] == 3 and all(n == 2 for n in sizes[1:-1])
    return len(groups) == 1 or threes or twos


@dataclass
class Amount:
    start: int
    end: int
    value: Decimal
    marked: bool  # by currency, grouping or multiplier
    ranged: bool = False


def amounts(text: str) -> list[Amount]:
    """All numbers that stand alone, with currency, multiplier and "/-" around them."""
    atoms, found, i = Atoms(text), [], 0
    spans: list[tuple[int, int]] = []
    while i < len(atoms):
        if not is_number(atoms[i]):
            i += 1
            continue
        j, groups, fraction = i + 1, [atoms[i]], ""
        while atoms[j] == "," and is_number(atoms[j + 1]):
            groups.append(atoms[j + 1])
            j += 2
        if atoms[j] == "." and is_number(atoms[j + 1]):
            fraction, j = atoms[j + 1], j + 2
        tangled = atoms[j] in (".", ",") and is_number(atoms[j + 1])
        begin, currency = before(atoms, i)
        if not is_grouped(groups) or tangled or begin is None:
            i = j
            continue
        end, unit = j, 1
        word = atoms.after_spaces(j)
        name = atoms[word]
        if name.lower() in MULTIPLIERS and name != "l" and not joins(atoms[word + 1]):  # a small l is for litres
            end, unit = word + 1, MULTIPLIERS[name.lower()]
        value = Decimal("".join(groups) + "." + (fraction or "0")) * unit
        if atoms[end] == "/" and atoms[end + 1] == "-":
            end += 2
        found.append(Amount(atoms.starts[begin], atoms.starts[end], value, currency or unit > 1 or len(groups) > 1))
        spans.append((begin, end))
        i = max(end, j)
    for a, b, (_, left), (right, _) in zip(found, found[1:], spans, spans[1:]):
        between = "".join(atoms.all[left:right]).strip().lower()
        a.ranged, b.ranged = (a.ranged or between in RANGE_MARKS), between in RANGE_MARKS
    return found


def before(atoms: Atoms, i: int) -> tuple[int | None, bool]:
    """The atom where the amount with its number at i begins, and whether that is a currency; None if the number
    only ends something longer."""
    k = atoms.after_spaces(i - 1, -1)
    sign = k - 1 if atoms[k] == "." else k
    if atoms[k] == CURRENCY_SIGN or atoms[sign].lower() in CURRENCY_WORDS:
        begin = k if atoms[k] == CURRENCY_SIGN else sign
        last = atoms[begin - 1]
        if not joins(last) and last not in (".", ","):
            return begin, True
    last = atoms[i - 1]
    return (None, False) if joins(last) or last in (".", ",") else (i, False)


def plain_amounts(text: str) -> str:
    """Marked whole amounts as plain integers; ranges and fractions stay as they are."""
    out, at = [], 0
    for a in amounts(text):
        if a.marked and not a.ranged and a.value == int(a.value):
            out += [text[at : a.start], str(int(a.value))]
            at = a.end
    return "".join([*out, text[at:]])


#: What an atom must be for each kind of step; other kinds are the atom itself.
FITS = {
    "_": str.isspace, "sep": lambda a: a in ("-", "/", "."), "mon": lambda a: a.lower() in MONTH_NUMBERS, "th": lambda a: a.lower() in ("st", "nd", "rd", "th"),
    "Y4": lambda a: is_number(a) and len(a) == 4, "YY": lambda a: is_number(a) and len(a) in (2, 4), "M2": lambda a: is_number(a) and len(a) == 2, "D2": lambda a: is_number(a) and len(a) == 2,
    "M": lambda a: is_number(a) and len(a) <= 2, "D": lambda a: is_number(a) and len(a) <= 2,
}


@cache
def steps(layout: str) -> list[tuple[str, bool]]:
    """Kind of each step, and whether it may be missing."""
    return [(step.rstrip("?"), step.endswith("?")) for step in layout.split()]


def matched(atoms: Atoms, i: int, layout: str) -> tuple[int, dict[str, int]] | None:
    """Where a layout that starts at atom i ends, and the parts it has."""
    parts: dict[str, int] = {}
    for kind, optional in steps(layout):
        atom, test = atoms[i], FITS.get(kind)
        if test(atom) if test else atom == kind:
            if kind == "mon":
                parts["M"] = MONTH_NUMBERS[atom.lower()]
            elif kind[0] in "YMD":
                parts[kind[0]] = int(atom) + (2000 if kind == "YY" and len(atom) == 2 else 0)
            i += 1
        elif not optional:
            return None
    return None if joins(atoms[i]) else (i, parts)


@dataclass
class Dated:
    first: int  # atoms
    last: int
    start: int
    end: int
    day: date


def full_dates(atoms: Atoms) -> list[Dated]:
    found, i = [], 0
    while i < len(atoms):
        step = i + 1
        # all layouts begin with a number or a month
        if (is_number(atoms[i]) or atoms[i].lower() in MONTH_NUMBERS) and not joins(atoms[i - 1]):
            for layout in LAYOUTS:
                got = matched(atoms, i, layout)
                if got:
                    end, p = got
                    try:
                        found.append(Dated(i, end, atoms.starts[i], atoms.starts[end], date(p["Y"], p["M"], p["D"])))
                    except ValueError:
                        continue
                    step = end
                    break
        i = step
    return found


def dates_in(text: str) -> list[tuple[int, int, date]]:
    """Full calendar dates of a text in order; day first, two-digit years from 2000."""
    return [(d.start, d.end, d.day) for d in full_dates(Atoms(text))]


def next_first(month: int, reference: date) -> date:
    """The first of a month, this year or next, after the reference."""
    return date(reference.year + (date(reference.year, month, 1) <= reference), month, 1)


def bare_months(atoms: Atoms, full: list[Dated], reference: date) -> list[tuple[int, date]]:
    """Months outside full dates, with their own year or the next one to come: first atom and first day."""
    inside = {k for d in full for k in range(d.first, d.last)}
    found = []
    for i, atom in enumerate(atoms.all):
        month = MONTH_NUMBERS.get(atom.lower())
        if month is None or i in inside or joins(atoms[i - 1]) or joins(atoms[i + 1]):
            continue
        k = i + 1 + (atoms[i + 1] == ".")
        k += atoms[k] == ","
        year = atoms[k + 1] if atoms[k].isspace() else ""
        if is_number(year) and len(year) == 4 and not joins(atoms[k + 2]) and int(year):
            found.append((i, date(int(year), month, 1)))
        elif reference.year < 9999:
            found.append((i, next_first(month, reference)))
    return found


def is_cued(atoms: Atoms, i: int) -> bool:
    """Does a word like "from" or "since" stand before atom i, maybe with "the first of"?"""
    k = i - 1
    if not atoms[k].isspace():
        return False
    while k >= 0 and (atoms[k].isspace() or atoms[k].lower() in FILLERS):
        k -= 1
    word = atoms[k].lower()
    letters = "".join(a for a in atoms.all[max(0, k - 5) : k + 1] if a != ".").lower()
    return word in START_WORDS or (word in (".", "f") and letters.endswith("wef"))


def start_in(text: str, reference: date) -> date:
    """The date that a start word precedes, else the first full date, else the reference."""
    atoms = Atoms(text)
    full = full_dates(atoms)
    starts = sorted([(d.first, d.day) for d in full] + bare_months(atoms, full, reference))
    return next((day for i, day in starts if is_cued(atoms, i)), full[0].day if full else reference)


def words_from(atoms: Atoms, i: int) -> list[str]:
    """The next three words from atom i, spaces left out; something else ends them."""
    found: list[str] = []
    while len(found) < 3 and (joins(atoms[i]) or (found and atoms[i].isspace())):
        if not atoms[i].isspace():
            found.append(atoms[i].lower())
        i += 1
    return found


def relative_day(atoms: Atoms) -> int | None:
    """Days from today that the first relative words mean."""
    for i in range(len(atoms)):
        if not joins(atoms[i]) or joins(atoms[i - 1]):
            continue
        words = words_from(atoms, i)
        for n in (1, 2):
            days = RELATIVE_DAYS.get(" ".join(words[:n]))
            if days:
                return days
        if len(words) == 3 and words[0] == "in" and is_number(words[1]) and len(words[1]) <= 3 and words[2] in UNIT_DAYS:
            return int(words[1]) * UNIT_DAYS[words[2]]
    return None


def later_day(day: int, month: int, today: date) -> date | None:
    """The next such day after today, this year or the next."""
    for year in (today.year, today.year + 1):
        try:
            found = date(year, month, day)
        except ValueError:
            return None
        if found > today:
            return found
    return None


def reminder_day(text: str, today: date) -> date | None:
    """When an instruction means: relative words first, then a full date, a day and month to come, a month after a
    word like "by"."""
    atoms = Atoms(text)
    days = relative_day(atoms)
    if days is not None:
        return today + timedelta(days=days)
    full = full_dates(atoms)
    if full:
        return full[0].day
    for i in range(len(atoms)):
        got = matched(atoms, i, "D th? _ mon") or matched(atoms, i, "D th? _ of _ mon") if is_number(atoms[i]) and not joins(atoms[i - 1]) else None
        if got and (found := later_day(got[1]["D"], got[1]["M"], today)):
            return found
    for i, atom in enumerate(atoms.all):
        month = MONTH_NUMBERS.get(atoms[i + 2].lower()) if atom.lower() in BEFORE_A_MONTH and atoms[i + 1].isspace() else None
        if month and not joins(atoms[i - 1]) and not joins(atoms[i + 3]):
            return next_first(month, today)
    return None
