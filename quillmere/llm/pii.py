"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: everything that the exact base patterns accept, and looser forms
(addresses spelled with "at" and "dot" in any case, digits of a telephone or card number with any of the usual separators or
none, IP addresses with spelled or spaced dots, IPv6), and three kinds that have no base pattern: iban (account numbers),
ssn (national numbers) and secret (keys, tokens, passwords, private key blocks). Boosted trees score each loose
candidate from its format and its context. Their scores are calibrated on examples of their own, per kind, and a candidate
is redacted from the threshold on at which the calibrated precision is PRECISION. Spans of base patterns are always kept; a
candidate that touches one, or a better candidate, is dropped.

The trees are trained here, on made-up examples from a seed (N_TRAIN of them, about a second), once in a process. No document
is needed for that, so the size of the input plays no role.

Base patterns (leftmost, not overlapping within a kind; what fails its check is dropped and not tried again):
email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits).

Each text is searched whole and by itself. Defined cases: a null text is empty; a text without digits, @ or the words of a
spelled address has no spans; very long texts take linear time; repeated rows are searched each by itself; an empty table
gives an empty result; other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmere.shared import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: And those that only candidates have.
ALL_KINDS = (*KINDS, "iban", "ssn", "secret")

#: The base patterns. A match of them can begin only where a run of its first class begins, or where the
#: match before ended, so the look-behinds change nothing but the time that long runs take.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        # what lies between this sign and the next one is looked at once, from either side
        end, at = max(end, at + 1), text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- candidates -----------------------------------------------------------------------------------------------------

AT_SIGN = re.compile(r" {0,2}[\[({<] ?(?:at|arroba|@) ?[\])}>] {0,2}|(?<=[A-Za-z0-9_]) {1,2}(?:at|arroba|@) {1,2}|@ ?| @", re.I)
LOOSE_LOCAL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: {0,2}[\[({<] ?(?:dot|punkt|punto|point|\.) ?[\])}>] {0,2}| {1,2}(?:dot|punkt|punto|point|\.) {1,2}|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
#: Digits with up to three separators between two of them. It is cut at blanks into the numbers that may be meant.
DIGITS = re.compile(r"(?<![\w+])\+?(?:\( ?)?[0-9](?:[ ()./_–-]{0,3}[0-9])*")
PARTS = 7
LOOSE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: {0,2}[\[({] ?(?:dot|\.) ?[\])}] {0,2}| {1,2}dot {1,2}| {0,2}\. {0,2})[0-9]{1,3}){3}(?![\w])(?!\.[0-9])", re.I)
IP_6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
PHONE_WORDS = re.compile(r"\b(?:tel|telefon|telefono|teléfono|téléphone|phone|mobile|mobil|cell|call|fax|whatsapp|handy|number|nummer)\b", re.I)
MAIL_WORDS = re.compile(r"\b(?:mail|e-mail|email|contact|write|reach|correo|kontakt)\b", re.I)
IP_WORDS = re.compile(r"\b(?:ip|ipv4|ipv6|host|server|address|addr|ping|client|from)\b", re.I)
CARD_WORDS = re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte|cc)\b", re.I)
IBAN_WORDS = re.compile(r"\b(?:iban|account|konto|cuenta|compte|bank|acct)\b", re.I)
SSN_WORDS = re.compile(r"\b(?:ssn|social security|national id|passport|tax id|nino|dni|insurance)\b", re.I)
SECRET_WORDS = re.compile(r"(?:token|secret|password|passwd|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential|passwort|kennwort|contraseña|mot de passe)", re.I)
WORDS = {"email": MAIL_WORDS, "ip": IP_WORDS, "card": CARD_WORDS, "phone": PHONE_WORDS, "iban": IBAN_WORDS, "ssn": SSN_WORDS, "secret": SECRET_WORDS}
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9]{3}(?<![0-9A-Za-z-]...)([- ])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])")
#: A name, a sign of assignment and what is assigned; a run without blanks that is long enough for a key; a key block.
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|passwort|kennwort|contraseña|pwd|passphrase|key|auth(?:orization)?|bearer|credentials?)[\"']?(?: ?[:=]+>? ?| is | )(?:bearer )?[\"'`]?([^\s\"'`,;<>]{6,})", re.I)
ASSIGNED_WORDS = ("token", "secret", "passw", "kennwort", "contraseña", "pwd", "passphrase", "key", "auth", "bearer", "credential")
RUN = LOCAL - frozenset(".%") | frozenset("/=")
RUN_FROM_DIGIT = re.compile(r"[0-9][A-Za-z0-9+/_=-]*")
TWO_DIGITS = re.compile(r"[0-9]{2}")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")
PREFIXES = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|pk_live_|AIza|eyJ|glpat-|npm_)")
ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu example test".split())

FEATURES = ("kind", "length", "digits", "groups", "longest_group", "shortest_group", "parens", "dots", "dashes", "spaces", "brackets", "known_ending", "word_before", "word_near", "digit_before", "digit_after", "upper_share", "grouping_3_3_4", "year_like", "slashes", "plus", "first_zero", "luhn", "byte_parts", "colons", "at_bare", "iban_valid", "assigned", "mix", "hex", "variety", "known_prefix", "ssn_range")


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for chain in DIGITS.finditer(text):
        if chain.end() - chain.start() < 6:
            continue
        parts = [(m.start(), m.end(), sum("0" <= c <= "9" for c in m[0])) for m in re.compile(r"[^ ]+").finditer(text, *chain.span())]
        parts = [p for p in parts if p[2]]
        if text[chain.end() : chain.end() + 1].isalnum():
            parts.pop()
        for i in range(len(parts)):
            for j in range(min(i + PARTS, len(parts)) - 1, i - 1, -1):
                n = sum(p[2] for p in parts[i : j + 1])
                if not 6 <= n <= 19:
                    continue
                start, end = parts[i][0], parts[j][1]
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                while text[start] not in "+(0123456789" or text[start] == "(" and ")" not in text[start:end]:
                    start += 1
                if n <= 15:
                    yield ("phone", start, end)
                if n >= 13:
                    yield ("card", start, end)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Loose forms; they may overlap base spans and one another."""
    for m in AT_SIGN.finditer(text):
        local = LOOSE_LOCAL.search(text, max(0, m.start() - 65), m.start())
        domain = LOOSE_DOMAIN.match(text, m.end()) if local else None
        if local and domain:
            yield ("email", local.start(), domain.end())
    if "." in text or "dot" in text.lower():
        for m in LOOSE_IP.finditer(text):
            yield ("ip", *m.span())
    if ":" in text:
        for m in IP_6.finditer(text):
            if m.end() - m.start() > 2:
                yield ("ip", *m.span())
    yield from _numbers(text)
    taken = 0
    for pair in TWO_DIGITS.finditer(text):  # digits are rare in prose: what starts from them leaves the rest of it alone
        if pair.start() - 2 < taken or not (m := IBAN.match(text, pair.start() - 2)):
            continue
        taken = m.end()
        yield ("iban", *m.span())
        for blank in re.finditer(" ", m[0]):  # what follows the number may look like its next group
            if blank.start() >= 15:
                yield ("iban", m.start(), m.start() + blank.start())
    if "-" in text or " " in text:
        for m in SSN.finditer(text):
            yield ("ssn", *m.span())
    taken = 0
    for m in RUN_FROM_DIGIT.finditer(text):
        start = m.start()
        while start > taken and text[start - 1] in RUN:
            start -= 1
        taken = m.end()
        # words alone, and numbers alone, are left to the other kinds
        if m.end() - start >= 16 and not text[start : m.end()].isdigit():
            yield ("secret", start, m.end())
    lower = text.lower()
    if any(w in lower for w in ASSIGNED_WORDS):
        for m in ASSIGNED.finditer(text):
            end = m.end(1)
            while end > m.start(1) + 6 and text[end - 1] in ".)]}:":
                end -= 1
            yield ("secret", m.start(1), end)
    if "-----BEGIN" in text:
        for m in KEY_BLOCK.finditer(text):
            yield ("secret", *m.span())


def iban_valid(body: str) -> bool:
    s = body.replace(" ", "").replace("-", "").upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _shape(kind: str, text: str, start: int, body: str) -> list[float]:
    """Features that only the kinds without a base pattern have."""
    if kind not in ("iban", "ssn", "secret"):
        return [0.0] * 7
    head = body[:64]
    sorts = [any(c.islower() for c in head), any(c.isupper() for c in head), any(c.isdigit() for c in head), any(not c.isalnum() for c in head)]
    assigned = bool(re.search(r"[:=]>? ?[\"'`]?\Z", text[max(0, start - 4) : start]))
    area = body[:3]
    return [
        kind == "iban" and iban_valid(body), assigned, sum(sorts), bool(re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", body)), len(set(head)) / max(1, len(head)), bool(PREFIXES.match(body)) or body.startswith("-----BEGIN"),
        kind == "ssn" and area not in ("000", "666") and area < "900" and body[4:6] != "00" and body[7:] != "0000",
    ]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    body = text[start : min(end, start + 4096)]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.findall(r"[0-9]+", body)
    words = WORDS[kind]
    sizes = [len(g) for g in groups]
    digits = "".join(groups)
    return [
        ALL_KINDS.index(kind), min(len(body), 512), sum(sizes), len(groups), max(sizes, default=0), min(sizes, default=0), body.count("(") + body.count(")"), body.count("."), body.count("-"), body.count(" "),
        sum(body.count(c) for c in "[]{}()"), re.split(r"[\W_]+", body.lower().rstrip(")]} "))[-1] in ENDINGS, bool(words.search(before[-12:])), bool(words.search(before) or words.search(after)),
        bool(re.search(r"[0-9]\W{0,2}\Z", before)), bool(re.match(r"\W{0,2}[0-9]", after)), sum(c.isupper() for c in body) / max(1, len(body)), sizes[-3:] == [3, 3, 4], bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20"),
        body.count("/"), body[0] == "+", digits[:1] == "0", 13 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), body.count(":"), bool(re.search(r"[A-Za-z0-9] (?:at|arroba) [A-Za-z0-9-]+\.", body, re.I)),
        *_shape(kind, text, start, body),
    ]


# --- boosted trees --------------------------------------------------------------------------------------------------


class Boosted:
    """Gradient boosting of the logistic loss with trees of a fixed depth; splits at quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[list[tuple[int, float]] | tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        mean = y.mean()
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * gs / (hs + 1.0)
        if not depth or len(rows) < 20:
            return leaf
        best = (1e-6, None, None)
        for f, at in enumerate(cuts):
            column = x[rows, f]
            for c in at:
                left = column <= c
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl * gl / (hl + 1.0) + (gs - gl) ** 2 / (hs - hl + 1.0) - gs * gs / (hs + 1.0)
                if gain > best[0]:
                    best = (gain, f, c)
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._apply(tree[2], x), self._apply(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)


#: Made-up examples for training, and as many more for calibration.
N_TRAIN = 3000
PRECISION = 0.98


def examples(n: int, seed: int) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """(text, kind, start, end) of candidates in made-up sentences, and whether they are personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 5)))
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    prose = lambda: " ".join(word() for _ in range(rng.integers(2, 8)))
    rows, labels = [], []
    valid = lambda k: next(d for d in iter(lambda: pick(*"3456") + number(k - 1), None) if luhn(d))
    wrong = lambda k: next(d for d in iter(lambda: number(k), None) if not luhn(d))
    grouped = lambda d, by: by.join((d[:4], d[4:10], d[10:]) if len(d) == 15 else (d[i : i + 4] for i in range(0, len(d), 4)))
    part = lambda: str(rng.integers(0, 256))
    digit = lambda: str(rng.integers(1, 10))
    hexes = lambda k: ":".join(f"{rng.integers(0, 65536):x}" for _ in range(k))
    call = lambda: pick("call ", "tel ", "phone: ", "Tel. ", "mobile ", "fax ", "Telefon ", "TEL: ", "whatsapp ", "my number is ")
    while len(rows) < n:
        case = rng.integers(20)
        lead = ""
        if case in (0, 8):
            at, dot = pick(" [at] ", "(at)", " (at) ", "[at]", " {at} ", " at ", " @ ", "[@]", " arroba ", "<at>"), pick(" [dot] ", "(dot)", " (dot) ", "[dot]", ".", " dot ", "[.]", " punto ")
            body, kind, good = f"{word()}{pick('', '.', '_')}{pick('', number(2))}{at}{word()}{dot}{pick(*sorted(ENDINGS))}", "email", True
            body = pick(body, body.upper(), body.replace("at", "AT").replace("dot", "DOT"), body.title()) if case else body
            if at == " at " and dot == ".":
                lead = pick("mail ", "e-mail: ", "contact ", "write to ")
        elif case == 1:
            body, kind, good = f"{word()} at {word()}{pick('.', ' dot ')}{word()}", "email", False
            body = pick(body, body, body.title(), body.upper())
        elif case in (2, 3):
            lead, kind, good = call(), "phone", True
            body = pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", f"0{number(2)} {number(4)} {number(4)}")
        elif case == 4:
            body, kind, good = pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"), "phone", True
        elif case == 5:
            body, kind, good = pick(f"{pick('19', '20')}{number(2)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{pick('19', '20')}{number(2)}", f"{pick('19', '20')}{number(2)}-{pick('19', '20')}{number(2)}"), "phone", False
            body = pick(body, body.replace("-", "/").replace(".", "/"), f"{body} {number(2)}")
        elif case == 6:
            body, kind, good = pick(f"{number(2)} {number(3)}", f"{number(3)} {number(3)}", f"{number(4)}.{number(2)}", f"{number(3)} {number(2)} {number(2)}", f"{number(4)}-{number(4)}-{number(4)}", f"{number(4)} {number(4)} {number(4)} {number(4)}"), "phone", False
            lead = pick("", "page ", "room ", "items ", "order ", f"{number(3)} ")
        elif case == 7:
            body, kind, good = pick(f"{number(3)}-{number(3)}", f"{number(2)}-{number(3)}", f"{number(2)}.{number(2)}.{number(2)}"), "phone", False
        elif case in (9, 10):
            lead, kind, good = call(), "phone", True
            body = pick(
                number(int(rng.integers(7, 13))), f"0{number(2)} {number(7)}", f"0{number(3)}/{number(7)}", f"{digit()}-{number(3)}-{number(3)}-{number(4)}", f"({number(3)}){number(3)}-{number(4)}", f"0{number(2)}/{number(3)} {number(2)} {number(2)}", f"0{digit()} {number(2)} {number(2)} {number(2)} {number(2)}",
                f"{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"00{number(2)} {number(2)} {number(7)}", f"+{number(2)}/{number(3)}/{number(6)}", f"{digit()} ({number(3)}) {number(3)}-{number(4)}", f"(0{number(2)}) {number(7)}",
            )
        elif case == 11:
            lead, kind, good = pick("", "id ", "order ", "item ", "total ", "isbn ", "ref "), "phone", False
            body = pick(number(int(rng.integers(6, 13))), f"{number(3)} {number(3)} {number(3)}", f"{number(2)}/{number(2)}/{pick('19', '20')}{number(2)}", f"978-{digit()}-{number(2)}-{number(6)}-{digit()}", f"{number(4)}/{number(4)}", f"{digit()} {number(3)} {number(3)}", f"{number(6)}.{number(2)}")
        elif case == 12:
            kind, good = "card", True
            lead = pick("", "card ", "visa ", "credit card: ", "amex ", "Karte ")
            k = int(pick(15, 16, 16))
            body = grouped(valid(k), pick(".", "  ", "/", " - ", "\u2013", "_") if k == 16 else pick(" ", "-", ".", ""))
        elif case == 13:
            kind, good, lead = "card", False, pick("", "id ", "tracking ", "order ", "serial ")
            k = int(pick(13, 14, 15, 16))
            body = pick(wrong(k), grouped(wrong(k), pick(".", " ", "-", "/", "  ")))
        elif case in (15, 16):
            kind, good = "secret", True
            mixed = lambda k: "".join(pick(*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
            hexed = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))
            lead = pick("token = ", "token: ", "secret=", "api_key: ", "API_KEY=", "password: ", "auth token ", "access_key = ", "client_secret: ", "bearer ", "") + pick("", '"', "'")
            body = pick(hexed(int(pick(32, 40, 64))), mixed(int(rng.integers(20, 48))), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(int(rng.integers(24, 48))), f"xoxb-{number(11)}-{mixed(24)}", f"eyJ{mixed(30)}")
            if lead[:4] in ("pass",):
                body = pick(body, f"{pick(word().title(), word() + word())}{number(int(rng.integers(1, 5)))}{pick('!', '#', '$', '_', word() + '!')}", mixed(int(rng.integers(8, 16))))
            elif not lead.strip("\"'") and not PREFIXES.match(body):
                lead = pick("key ", "token ", "commit key: ")
        elif case == 17:
            kind, good = "secret", False
            lead = pick("", "", "token ", "the key ", "password ", "secret is ", "token: ", "see ")
            body = pick(f"{word()}-{word()}-{number(2)}-{word()}{word()}", f"{word()}_{word()}_{word()}{number(1)}{word()}", f"{word()}/{word()}/{word()}/{number(2)}/{word()}", f"{word()}{word()}{word()}{number(1)}x{word()}", "=" * 20 + "1", f"{pick('19', '20')}{number(2)}-{number(2)}-{number(2)}T{number(2)}{number(2)}{number(2)}Z")
            if lead.strip() in ("the key", "password", "secret is", "token"):
                body = pick(body, word() + word() + word(), "economy", "exchange")
        elif case == 18:
            kind = "iban"
            lead, land, rest = pick("", "IBAN ", "iban: ", "account ", "Konto "), pick("DE", "FR", "GB", "ES", "NL", "IT", "AT"), number(int(rng.integers(14, 21)))
            check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
            good = bool(rng.integers(4))
            flat = f"{land}{check if good else (check + int(rng.integers(1, 90))) % 97 or 97:02d}{rest}"
            good = good or iban_valid(flat)
            body = pick(flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)))
        elif case == 19:
            kind, good = "ssn", bool(rng.integers(3))
            lead = pick("", "SSN ", "ssn: ", "social security ") if good else pick("", "part ", "ref ")
            body = f"{int(rng.integers(1, 899)):03d}-{int(rng.integers(1, 99)):02d}-{int(rng.integers(1, 9999)):04d}" if good else f"{pick('000', '9' + number(2), number(3))}{pick('-', ' ')}{pick('00', number(2))}{{}}{number(4)}"
            if not good:
                body = body.format("-" if "-" in body else " ")
                body = body if not lead else f"{pick('000', '9' + number(2))}{body[3:]}"
                body = body if body[:3] in ("000",) or body[0] == "9" or lead else f"9{body[1:]}"
        else:
            kind, good, lead = "ip", bool(rng.integers(2)), ""
            if good:
                lead = pick("", "ip ", "host ", "server ", "from ")
                body = pick(pick("[.]", "(.)", " . ", " dot ", "[dot]", " [dot] ", " DOT ").join(part() for _ in range(4)), hexes(8), f"{hexes(2)}::{hexes(1)}", f"fe80::{hexes(int(rng.integers(1, 5)))}")
            else:
                body = pick(pick(". ", " . ", " dot ").join(str(rng.integers(256, 1000)) for _ in range(4)), ". ".join(number(int(rng.integers(1, 4))) for _ in range(4)), f"::{pick('ad', 'be', 'face', 'add')}", f"{pick('a', 'bad', 'ace')}::{pick('dad', 'fed', 'b')}")
        text = f"{prose()} {lead}{body}{pick('', '.', ',')} {prose()}"
        start = text.index(lead + body) + len(lead)
        rows.append((text, kind, start, start + len(body)))
        labels.append(good)
    return rows, np.array(labels, float)


def _with_parts(n: int, seed: int) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """Examples, and as wrong ones what else the generators propose in the same texts."""
    rows, y = examples(n, seed)
    more = []
    for row in rows:
        base = base_spans(row[0])
        more += [(row[0], *c) for c in dict.fromkeys(candidates(row[0])) if c != row[1:] and not _touches(_starts(base), c)]
    return rows + more, np.append(y, np.zeros(len(more)))


@functools.cache
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the score from which the calibrated precision on examples of their own is PRECISION."""
    rows, y = _with_parts(N_TRAIN, 1)
    trees = Boosted(rounds=80, depth=4).fit(np.array([features(*r) for r in rows], float), y)
    rows, y = _with_parts(N_TRAIN, 2)
    score = trees.score(np.array([features(*r) for r in rows], float))
    limits = {}
    for kind in ALL_KINDS:
        own = np.array([r[1] == kind for r in rows])
        order = np.argsort(-score[own], kind="stable")
        s, good = score[own][order], y[own][order]
        # the precision among all candidates from a score on; equal scores go together
        precision = np.cumsum(good) / np.arange(1, len(good) + 1)
        enough = np.flatnonzero((precision >= PRECISION) & (np.append(np.diff(s), -1.0) < 0))
        limits[kind] = max(0.0, float(s[enough[-1]])) if len(enough) else np.inf  # and more likely than not
    return trees, limits


def _starts(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, end), and none that ends before the one before it."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        out.append((a, max(b, out[-1][1]) if out else b))
    return out


def _touches(taken: list[tuple[int, int]], span: tuple[str, int, int]) -> bool:
    i = bisect.bisect_left(taken, (span[2], 0))
    return i > 0 and taken[i - 1][1] > span[1]


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the trees select beside the base spans: the best candidates first, none touching another span."""
    taken = _starts(base)
    found = [c for c in dict.fromkeys(candidates(text)) if not _touches(taken, c)]
    if not found:
        return []
    trees, limits = model()
    scores = trees.score(np.array([features(text, *c) for c in found], float))
    out: list[tuple[str, int, int]] = []
    taken = []
    for i in np.argsort(-scores, kind="stable"):
        kind, start, end = found[i]
        if scores[i] >= limits[kind] and not _touches(taken, found[i]):
            bisect.insort(taken, (start, end))
            out.append(found[i])
    return out


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


_MARK = re.compile(r"[0-9@\[({<]").search
_WORDS = (" at ", " arroba ", "::", *ASSIGNED_WORDS)


def _any(text: str) -> bool:
    """False only for texts without any candidate."""
    return _MARK(text) is not None or any(map(text.lower().__contains__, _WORDS))


_ADDED = (*(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_spans")


def detect(df: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base matches), base_spans, spans, n_spans (of all) and, if asked for, redacted.

    The text itself is in the result only if it stands in df under another name or redacted is asked for.
    """
    bound_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (*_ADDED, "redacted", text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names), *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string", "n_spans long", *(["redacted string"] if redacted else [])])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts: list[list[int]] = [[] for _ in KINDS]
                bases, every, clean, sums = [], [], [], []
                for t in batch.column(len(names)).to_pylist():
                    t = t or ""
                    base = base_spans(t) if _any(t) else []
                    spans = base + added_spans(t, base) if _any(t) else []
                    for kind, column in zip(KINDS, counts, strict=True):
                        column.append(sum(k == kind for k, _, _ in base))
                    bases.append(spell(base))
                    every.append(spell(spans))
                    sums.append(len(spans))
                    if redacted:
                        clean.append(redact(t, spans))
                columns = [*(batch.column(i) for i in range(len(names))), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(every, pa.string()), pa.array(sums, pa.int64()), *([pa.array(clean, pa.string())] if redacted else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *_ADDED, *(["redacted"] if redacted else [])])

    return df.select(*names, text).mapInArrow(find, schema)
