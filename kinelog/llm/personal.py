"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find emails, IP addresses, card and phone numbers. The field labels words; it adds spans that no pattern
has: secrets, phone numbers without a country code, social security numbers (id), account numbers (iban) and names after a
title or a field name. It is trained by maximum likelihood on the small table ``labelled()``. Only ``candidates`` may have a
label other than O (words with a digit or ``@``, the letters inside a number, capitalised words after a title), so a text falls
into short chains of such words, between which the label is known; chains of one length are decoded together by Viterbi in
numpy.

Offsets count code points, ends are exclusive. Defined results: a null text is the empty text and has no span; null
ids are carried through; repeated rows are judged alike; a very long text is one task's work, with memory in proportion to
it, and words count whole; of field spans that overlap a base span or an earlier one, none is added; extra columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import carried, chunks, mapped, table

#: Kinds in order, and what the patterns match.
KINDS = ("email", "ip", "card", "phone", "secret", "id", "iban", "name")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these can begin inside a run of digits, which the look-behind says at once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_BANK = re.compile(r"[A-Z]{4}")
#: What a key's maker puts before it: letters, then a mark, then a long random word.
_PREFIX = re.compile(r"[A-Za-z]{2,6}(?:[-_][a-z]{2,6})?[-_](?=[A-Za-z0-9_-]{16,}$)")

LABELS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-secret", "B-id", "B-iban", "I-iban", "B-name", "I-name")
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame señor señora name contact patient employee applicant sincerely regards".split())
CUES = TITLES | frozenset(
    "token key secret password passwd passwort pwd api apikey bearer auth credentials card visa phone tel telefon téléphone teléfono call ring fax mobile cell email mail ip host server commit version page order"
    " ssn social iban account konto isbn invoice build checksum on whatsapp text sms dial reach model part sku serial release md5 sha1 sha256 hash digest".split()
)
_TITLE = re.compile(r"(?i)\b(?:" + "|".join(sorted(TITLES)) + r")\b")
ROUNDS, RATE, RIDGE = 300, 0.1, 1e-3

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds: whether a match ends well depends on its @ alone."""
    after = 0
    at = text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > after and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                after = domain.end()
                yield "email", start, after
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start and kind."""
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 12 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field.


def shape(word: str) -> str:
    """Upper case X, lower case x, digits d, the rest as it is; repeats once."""
    out = []
    for c in word:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def core(word: str, start: int) -> tuple[int, int]:
    """The place of a word without quotes around it and marks after it; of key=value only the value."""
    own = word.rstrip(".,;:!?\"'>")
    cut = max(own.rfind("="), own.rfind(":")) + 1
    value = own[cut:].lstrip("\"'<")
    return start + len(own) - len(value), start + len(own)


def plain(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()=")


def around(word: str | None) -> str:
    if word is None:
        return "-"
    own = plain(word)
    return own if own in CUES else shape(word)


def account(word: str) -> bool:
    """Whether a word is an account number by its check digits."""
    if not 15 <= len(word) <= 34 or not word.isascii() or not word.isalnum() or not word[:2].isalpha() or not word[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def candidates(words: list[str]) -> list[bool]:
    """Which words of a line may be labelled."""
    out: list[bool] = []
    named = False  # the word before is a title, or a name after one
    for i, w in enumerate(words):
        number = bool(_HINT.search(w))
        inside = not number and bool(_BANK.fullmatch(w)) and 0 < i < len(words) - 1 and bool(_HINT.search(words[i - 1])) and bool(_HINT.search(words[i + 1]))
        called = named and not number and w[0].isupper() and plain(w) not in TITLES
        out.append(number or inside or called)
        named = plain(w) in TITLES or called and w[-1] not in ".,;:!?" or called and len(plain(w)) == 1
    return out


def features(words: list[str], i: int) -> list[str]:
    """What the field sees of one word: its shape, sizes and checks, and the shapes of its neighbours."""
    a, b = core(words[i], 0)
    word = words[i][a:b]
    digits = only_digits(word)
    letters = sum(c.isalpha() for c in word)
    is_hex = len(word) >= 16 and all(c in "0123456789abcdefABCDEF" for c in word)
    checks = "iban" if account(word) else "card" if 12 <= len(digits) <= 19 and not letters and luhn(digits) else "hex" if is_hex and letters else "mixed" if len(word) >= 16 and letters and digits else "digits" if word == digits else "other"
    near = [words[j] if 0 <= j < len(words) else None for j in (i - 2, i - 1, i + 1)]
    key = words[i][:a].lower().strip("\"'=: ")
    key = next((part for part in re.split("[_-]", key) if part in CUES), key)
    return [
        "one", f"shape {shape(word)}", f"digits {min(len(digits), 20)}", f"size {min(len(word), 48) // 4}", f"check {checks}", f"key {key if key in CUES else bool(key)}",
        f"prefix {bool(_PREFIX.match(word)) and checks}", f"title {shape(near[1]) if near[1] and plain(near[1]) in TITLES else '-'}", f"before2 {around(near[0])}", f"before {around(near[1])}", f"after {around(near[2])}", f"{checks} before2 {around(near[0])}", f"{checks} before {around(near[1])}",
    ]


def chains(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], list[int]]]:
    """Words of a line, their places, and the numbers of neighbouring words that may be labelled."""
    offset = 0
    for line in text.split("\n"):
        if _HINT.search(line) or _TITLE.search(line):
            found = list(_WORD.finditer(line))
            words = [m[0] for m in found]
            run: list[int] = []
            for i, may in enumerate(candidates(words)):
                if may:
                    run.append(i)
                elif run:
                    yield words, [(offset + found[k].start(), offset + found[k].end()) for k in run], run
                    run = []
            if run:
                yield words, [(offset + found[k].start(), offset + found[k].end()) for k in run], run
        offset += len(line) + 1


def labelled(copies: int = 12) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with marked spans, filled with made-up values by a fixed seed."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(good: bool) -> str:
        while True:
            d = digits(rng.choice((13, 15, 16, 16, 16)))
            if luhn(d) == good:
                return d

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def hexes(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def mixed(n: int) -> str:
        return "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(n - 2)) + "7q"

    def pick(*forms: str) -> str:
        """One of the forms, # a digit."""
        return "".join(rng.choice("0123456789") if c == "#" else c for c in rng.choice(forms))

    def iban(groups: bool) -> str:
        country, bank = rng.choice((("DE", ""), ("GB", "".join(rng.choice(letters) for _ in range(4)).upper()), ("FR", ""), ("ES", ""), ("NL", "ABNA"[: 4 * rng.randrange(2)])))
        body = bank + digits(18 if not bank else 14)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if groups else whole

    def name() -> str:
        part = lambda: word().capitalize()
        return rng.choice((part, lambda: f"{part()} {part()}", lambda: f"{part()} {rng.choice(letters).upper()}. {part()}"))()

    makers = {
        "email": lambda: rng.choice((f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{word()}+{word()}@{word()}.co.uk")),
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "cards": lambda: "{0} {1} {2} {3}".format(*re.findall("....", card16())),
        "phone": lambda: pick("+# (###) ###-####", "+## ### ######", "+##.###.#######", "+## ## #### ####"),
        "local": lambda: pick("(###) ###-####", "###-###-####", "0## #### ####", "0# ## ## ## ##", "0##/#######", "### ####", "###.###.####", "0####-######", "0### #######"),
        "bare": lambda: pick("(###) ###-####", "###-###-####", "(0##) ####-####"),
        "secret": lambda: rng.choice((hexes(40), hexes(32), hexes(64), mixed(24), mixed(36), mixed(20) + "_" + mixed(16), f"sk-{mixed(30)}", f"ghp_{mixed(36)}")),
        "ssn": lambda: pick("###-##-####"),
        "iban": lambda: iban(False),
        "ibans": lambda: iban(True),
        "name": name,
        "badcard": lambda: card(False),
        "badip": lambda: f"{rng.randint(256, 999)}.{digits(2)}.{digits(3)}.{rng.randint(300, 999)}",
        "year": lambda: str(rng.randint(1800, 2030)),
        "date": lambda: pick("20##-0#-1#", "1#/0#/19##", "1#.0#.20##", "0#-1#-20##"),
        "small": lambda: digits(rng.randint(1, 4)),
        "money": lambda: pick("$##,###.##", "#,###,###", "€###.##", "###.##", "##%"),
        "version": lambda: pick("v#.#.##", "#.#", "#.##.#-beta#", "##.##.#"),
        "time": lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}",
        "isbn": lambda: pick("978-#-##-######-#", "97#-###-####-##-#"),
        "range": lambda: pick("#-##", "##-##", "19##-20##", "###-###"),
        "sha": lambda: rng.choice((hexes(40), hexes(64), hexes(10))),
        "uuid": lambda: f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-a{hexes(3)}-{hexes(12)}",
        "code": lambda: rng.choice((f"{word()}{digits(2)}", f"{word().upper()}-{digits(4)}", f"{word().capitalize()}{digits(1)}{word()}")),
        "url": lambda: rng.choice((f"http://{word()}{digits(1)}.example.org/en/{digits(3)}?page={digits(1)}", f"https://{word()}.net/{word()}/{digits(8)}")),
        "release": lambda: rng.choice((f"{word()}-{pick('#.#.#', '#.##.#', '#.#.#.#')}", f"{word()}-{pick('#.#.#')}.tar", pick("#.#.#-rc#", "v#.#.#.#-rc#", "#.##.#.dev#"), f"{word()}{pick('#.#')}")),
        "part": lambda: rng.choice((pick("###-##-####", "###-####", "##-####-##", "####-###", "###-###-####"), f"{word().upper()}-{digits(3)}-{digits(4)}")),
        "keyed": lambda: f"{rng.choice(('sk', 'pk', 'ghp', 'gho', 'xoxb', 'sk_live', 'pat', 'glpat'))}{rng.choice('-_')}{mixed(rng.choice((20, 30, 36)))}",
        "ident": lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + rng.choice(("", digits(1))) + rng.choice(("", f"_{word()}")),
        "w": word,
        "W": lambda: word().capitalize(),
    }

    def card16() -> str:
        while len(c := card(True)) != 16:
            pass
        return c

    kinds = {"email": "email", "ip": "ip", "card": "card", "cards": "card", "phone": "phone", "local": "phone", "bare": "phone", "secret": "secret", "ssn": "id", "iban": "iban", "ibans": "iban", "name": "name", "keyed": "secret"}
    templates = (
        "{w} {w} {email} {w} {w}.", "{w} {email}, {w}", "<{email}>", "{w} {w} {ip} {w}.", "server {ip}", "{w} from {ip}: {w}", "{w} {card} {w} {w}", "{w}, {card} {card} {w}", "card {cards}, {w}.", "visa: {cards}",
        "{w} {w}, {phone} {w}.", "{W} {w} {phone}", "call {local} {w}", "phone: {local}.", "tel {local}", "{w} fax {local}, {w}", "{w} mobile: {local}", "telefon {local} {w}", "{w} {bare} {w} {w}.", "{w} ring {local}.", "cell {local} {w}",
        '{w} {w} token = "{secret}" {w}', "{w} api key {secret} {w}", 'password: "{secret}"', "secret={secret} {w}", 'auth token="{secret}", {w}', "{w} bearer {secret}", "credentials {secret} {w}", "{w}_key: {secret}", '"apikey": "{secret}",', "passwd {secret}",
        "{w} {ssn} {w}", "ssn {ssn}.", "{w} social number {ssn}, {w}", "ssn: {ssn} {w}", "{w} {iban} {w}", "iban: {ibans}", "iban {ibans} {w}.", "account {iban}.", "{w} konto {ibans}, {w} {w}",
        "{w} mr. {name}, {w} {w}", "Mrs. {name}. {W} {w}", "dr {name}, {w}", "Name: {name}", "contact: {name}, {w}", "{w} frau {name}, {w} {w}", "patient {name}.", "Prof. {name}, {w} {date}", "Herr {name}, {w}", "Mr. {name}, {W} {w}",
        "sincerely, {name}", "kind regards, {name}", "Regards, {name}", "{w} {w} on {local}", "reach {w} on {local} {w}", "WhatsApp {local}", "whatsapp: {local}", "{w} sms {local}.", "text {w} on {local}", "{w} dial {local}",
        "{w} {keyed} {w}", "Frau {name} {w} {small}", "Mrs {name} {w}", "Herr {name}.", "konto {iban} {w}", "{w} konto {iban}.", "secret: {secret} {w}", "{w} secret {secret}.", "{w}_token={secret}", "{w}_secret: {secret}", "{w} {W} to {keyed}", "set {w} {keyed}.", "{keyed}", "{w}={keyed}",
        "Contact {W} {w}", "{W} Contact {W} {small}", "Patient {W} {year}", "Patient {W} {w} {w}", "Name {W} {small}", "Name {W} {W}", "Employee {W} {w}", "Applicant {W} {small}", "Employee {W} {W} {w}",
        "model {part} {w}", "{w} part {part}, {w}", "part no. {part}", "sku {part}", "serial {part} {w}", "{w} model {part}.", "{w} {w} {release} {w}", "into {release}", "release {release}", "{w} {release}, {w} {release}.",
        "{w} {ident}{small} {w}", "{w} {ident}_{small}", "{w} {ident}, {w}", "{w} on {small} {small} {small}", "{w} on {small} {small}.", "reach {small} {w}",
        "md5 {sha}", "sha256 {sha} {w}", "{w} sha1: {sha}", "hash {sha} {w}", "digest {sha}", "md5: {sha}", "{w} on {date}", "{w} on {small} {w}", "text {small} {w}",
        "{w} {badcard} {w} {w}.", "{w} {badip} {w}", "in {year} {w} {small} {w}", "{w} {small} {w}, {w}", "order {badcard} {w}", "{w} {badcard} {badcard} {w}", "{w}, {badcard} {w} {small} {badcard}", "{badcard} {small}", "invoice {badcard}", "{w} {money} {w}", "version {version} {w}", "build {version}, {w}", "{w} at {time}.", "{date} {time} {w}", "{w} {date}, {w}",
        "commit {sha} {w}", "checksum {sha}", "{w} {sha} {w}", "{w} {uuid}", "isbn {isbn} {w}", "{w} {isbn}.", "{w} {range} {w}", "page {range}", "{w} {code}, {w} {url}", "{url} {w}", "page {small} {w} {small}-{small}", "{small} {small} {small} {w}", "{small} {small} {small} {small} {small}", "{w} {W} {small} {W}",
        "token {w} {w} {small}", "key {small} {w}", "{w} phone {w} {w} {year}", "name {w} {w} {small}", "card {w} {small} {w}", "{w} account {small} {w}",
    )
    rows = []
    for template in templates:
        for _ in range(copies):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", template):
                if part.startswith("{"):
                    name = part[1:-1]
                    value = makers[name]()
                    if name in kinds:
                        spans.append((kinds[name], len(text), len(text) + len(value)))
                    text += value
                else:
                    text += part
            rows.append((text, spans))
    return rows


class Field:
    """Weights of the features and of neighbouring labels."""

    def __init__(self, rows: list[tuple[str, list[Span]]]) -> None:
        self.number: dict[str, int] = {}
        sequences = []
        for text, spans in rows:
            for words, places, run in chains(text):
                ids = [[self.number.setdefault(f, len(self.number)) for f in features(words, i)] for i in run]
                sequences.append((ids, [self._label(p, spans) for p in places]))
        self.emit = np.zeros((len(self.number) + 1, len(LABELS)))  # the last row is for what was never seen
        self.step = np.zeros((len(LABELS), len(LABELS)))
        # I- goes on from its own kind only.
        self.open = np.array([[b[0] != "I" or a[1:] == b[1:] and a[0] in "BI" for b in LABELS] for a in LABELS])
        self._fit(sequences)

    @staticmethod
    def _label(place: tuple[int, int], spans: list[Span]) -> int:
        for kind, a, b in spans:
            if place[0] < b and a < place[1]:
                return LABELS.index(("B-" if place[0] <= a else "I-") + kind)
        return 0

    def _batches(self, sequences: list) -> list[tuple[np.ndarray, np.ndarray]]:
        by_length = defaultdict(list)
        for ids, labels in sequences:
            by_length[len(ids)].append((ids, labels))
        return [(np.array([s[0] for s in x]), np.array([s[1] for s in x])) for x in by_length.values()]

    def _fit(self, sequences: list) -> None:
        """Maximum likelihood with a ridge: gradients by forward and backward sums, steps by Adam."""
        batches, n = self._batches(sequences), max(1, len(sequences))
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.emit, self.step)]
        for t in range(1, ROUNDS + 1):
            grads = [RIDGE * self.emit, RIDGE * self.step]
            for x, y in batches:
                self._add(x, y, grads, 1 / n)
            for w, g, (m, v) in zip((self.emit, self.step), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.emit[-1] = 0

    def _steps(self) -> np.ndarray:
        return np.where(self.open, self.step, -1e9)

    def _add(self, x: np.ndarray, y: np.ndarray, grads: list[np.ndarray], scale: float) -> None:
        scores, steps = self.emit[x].sum(2), self._steps()
        n, length, _ = scores.shape
        ahead, back = np.empty_like(scores), np.empty_like(scores)
        ahead[:, 0] = scores[:, 0] + steps[0]  # before a chain comes O
        for i in range(1, length):
            ahead[:, i] = scores[:, i] + np.logaddexp.reduce(ahead[:, i - 1, :, None] + steps, 1)
        back[:, -1] = steps[:, 0]  # and after it
        for i in range(length - 2, -1, -1):
            back[:, i] = np.logaddexp.reduce(steps + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(ahead[:, -1] + back[:, -1], 1)[:, None]
        one = np.eye(len(LABELS))
        for i in range(length):
            error = np.exp(ahead[:, i] + back[:, i] - total) - one[y[:, i]]
            np.add.at(grads[0], x[:, i], scale * error[:, None, :])
            both = one[y[:, i - 1]][:, :, None] * one[y[:, i]][:, None, :] if i else None
            if i:
                p = np.exp(ahead[:, i - 1, :, None] + steps + (scores[:, i] + back[:, i])[:, None, :] - total[:, :, None])
                grads[1] += scale * (p - both).sum(0)
        first, last = np.exp(ahead[:, 0] + back[:, 0] - total), np.exp(ahead[:, -1] + back[:, -1] - total)
        grads[1][0] += scale * (first - one[y[:, 0]]).sum(0)
        grads[1][:, 0] += scale * (last - one[y[:, -1]]).sum(0)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels of chains of one length (features of each word): Viterbi for all at once."""
        scores, steps = self.emit[x].sum(2), self._steps()
        n, length, _ = scores.shape
        best, came = scores[:, 0] + steps[0], np.empty((n, length, len(LABELS)), np.int64)
        for i in range(1, length):
            ways = best[:, :, None] + steps
            came[:, i] = ways.argmax(1)
            best = ways.max(1) + scores[:, i]
        labels = np.empty((n, length), np.int64)
        labels[:, -1] = (best + steps[:, 0]).argmax(1)
        for i in range(length - 1, 0, -1):
            labels[:, i - 1] = came[np.arange(n), i, labels[:, i]]
        return labels

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The field's spans of each text."""
        waiting, none = defaultdict(list), len(self.number)
        for t, text in enumerate(texts):
            for words, places, run in chains(text):
                ids = [[self.number.get(f, none) for f in features(words, i)] for i in run]
                waiting[len(run)].append((t, ids, places))
        out: list[list[Span]] = [[] for _ in texts]
        for some in waiting.values():
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                for (t, _, places), labels in zip(part, self.decode(np.array([p[1] for p in part])).tolist()):
                    out[t] += self._joined(texts[t], places, labels)
        return out

    @staticmethod
    def _joined(text: str, places: list[tuple[int, int]], labels: list[int]) -> list[Span]:
        found: list[list] = []
        for (a, b), label in zip(places, labels):
            name = LABELS[label]
            if name[0] == "O":
                continue
            start, end = core(text[a:b], a)
            if name[0] == "B":
                found.append([name[2:], start, end])
            else:
                found[-1][2] = end
        return [(k, a, b) for k, a, b in found if a < b]


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and these with the field's that touch none of them."""
    out = []
    for text, more in zip(texts, field.spans(texts)):
        base = base_spans(text)
        added: list[Span] = []
        if more:
            covered = np.zeros(len(text) + 1, bool)
            for _, a, b in base:
                covered[a:b] = True
            for k, a, b in more:
                if not covered[a:b].any():
                    added.append((k, a, b))
                    covered[a:b] = True
        out.append((base, in_order(base + added)))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with the kind in brackets for each stretch of overlapping spans."""
    out, last = [], 0
    for kind, a, b in spans:
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


@functools.cache
def trained() -> Field:
    """The field of the labelled table: a few hundred features, fitted once a process."""
    return Field(labelled())


def find(docs: DataFrame, with_text: bool = False, rows: list[tuple[str, list[Span]]] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) counts and digest of the base spans, all spans, if asked the redacted text, and columns to carry."""
    shared = docs.sparkSession.sparkContext.broadcast(trained() if rows is None else Field(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            found = all_spans([t or "" for t in texts], shared.value)
            yield [
                batch.column(0),
                *([sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS[:4]),
                [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                [joined(every) for _, every in found],
                *([[None if t is None else redacted(t, every) for t, (_, every) in zip(texts, found)]] if with_text else []),
                *batch.columns[2:],
            ]

    return mapped(docs.select("doc_id", "text", *carry), work, SCHEMA + (", redacted_text string" if with_text else "") + carried(docs, carry))


def op10_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
