"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds further spans.

A token is a run without ASCII white space. Whole batches of text become one
array of code points; token borders, shapes and cue words are found by array
operations, emissions are looked up per distinct shape, and all lines of a
batch go through Viterbi side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# --- fixed patterns ---------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does: saying so keeps long runs linear and finds the same spans.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed kinds in the order of KINDS, then start."""
    found = emails(text)
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# --- word shapes ------------------------------------------------------------

CUES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "name", "named", "signed", "sincerely", "dear", "contact", "call", "phone", "tel", "telephone",
    "mobile", "fax", "ssn", "passport", "licence", "license", "id", "iban", "account", "no", "number", "street", "st", "avenue", "ave", "road", "rd", "lane", "drive",
    "address", "lives", "at", "born", "patient", "employee", "customer", "by", "from", "the", "and", "of", "to", "in", "on", "is", "was", "version", "copyright",
    "figure", "table", "page", "chapter", "section", "total", "year",
)
#: Values of each shape feature: initial class, last class, digits, length, inner mark, capitals, cue word.
SIZES = (7, 6, 9, 8, 8, 4, len(CUES) + 1)
_BASE = 1_000_003
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(63, _BASE, dtype=np.uint64)])

_CLASS = np.full(65536, 4, dtype=np.uint8)  # 0 upper, 1 lower, 2 digit, 3 plus or bracket, 4 other letter or sign, 5 stop or comma, 6 colon
for _c in range(65, 91):
    _CLASS[_c] = 0
for _c in range(97, 123):
    _CLASS[_c] = 1
for _c in range(48, 58):
    _CLASS[_c] = 2
for _c in "+(":
    _CLASS[ord(_c)] = 3
for _c in ".,;!?)":
    _CLASS[ord(_c)] = 5
_CLASS[ord(":")] = 6
for _c in list(range(0xC0, 0xDF)):
    _CLASS[_c] = 0
for _c in list(range(0xDF, 0x100)):
    _CLASS[_c] = 1
_MARK = np.zeros(65536, dtype=np.uint8)
for _i, _c in enumerate("-./@'#:", 1):
    _MARK[ord(_c)] = _i


def _word_hash(word: str) -> int:
    return int(sum((ord(c) * pow(_BASE, i, 1 << 64)) for i, c in enumerate(word)) % (1 << 64))


_CUE_HASH = np.array([_word_hash(w) for w in CUES], dtype=np.uint64)
_CUE_ORDER = np.argsort(_CUE_HASH)


def tokens_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    solid = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shapes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One integer per token that holds all its feature values."""
    low = np.where(codes < 65536, codes, 65535)
    kind, mark = _CLASS[low], _MARK[low]
    last = ends - 1
    tail = np.where((kind[last] == 5) & (last > starts), last - 1, last)  # a closing stop is not the word's own end
    length = ends - starts
    total = lambda a: np.diff(np.r_[0, np.cumsum(a, dtype=np.int64)][np.c_[starts, ends]], axis=1)[:, 0]
    digits, upper = total(kind == 2), total(kind == 0)
    inner = mark.copy()
    inner[last] = 0
    inner[starts] = 0
    marks = np.maximum.reduceat(inner, starts) if len(starts) else inner[:0]
    folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
    letter = (folded >= 97) & (folded <= 122)
    within = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) if len(starts) and starts[0] == 0 else None
    if within is None and len(starts):
        within = np.arange(len(codes)) - np.r_[np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.r_[starts, len(codes)]))]
    weighted = np.where(letter & (within < 64), folded * _POWERS[np.clip(within, 0, 63)], np.uint64(0)) if len(starts) else folded
    running = np.r_[np.uint64(0), np.cumsum(weighted, dtype=np.uint64)]
    word = running[ends] - running[starts]
    at = np.searchsorted(_CUE_HASH[_CUE_ORDER], word)
    cue = np.where(_CUE_HASH[_CUE_ORDER][np.minimum(at, len(CUES) - 1)] == word, _CUE_ORDER[np.minimum(at, len(CUES) - 1)] + 1, 0)
    values = (
        kind[starts], np.minimum(kind[tail], 5), np.searchsorted([1, 2, 3, 4, 5, 9, 13, 17], digits, side="right"), np.searchsorted([2, 3, 4, 5, 7, 10, 15], length, side="right"),
        marks, np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper == length, 3, 2))), cue,
    )
    out = np.zeros(len(starts), dtype=np.int64)
    for value, size in zip(values, SIZES, strict=True):
        out = out * size + value
    return out


def unpack(shape: np.ndarray) -> np.ndarray:
    """Feature columns of shapes, each shifted to its own range of weight rows."""
    columns, rest = [], shape
    for size in reversed(SIZES):
        columns.append(rest % size)
        rest = rest // size
    offsets = np.cumsum(np.r_[0, SIZES[:-1]])
    return np.stack(columns[::-1], axis=1) + offsets


# --- the chain --------------------------------------------------------------

LABELS = ("name", "tel", "id", "address")
TAGS = ("O", *(f"{b}-{k}" for k in LABELS for b in "BI"))
ROWS = sum(SIZES)

#: Fillers of the labelled table.
NAMES = (
    "Peter Hansen", "Anna Keller", "Lucia Moreno", "Claire Dubois", "Oliver Grant", "Maria Lopez", "Thomas Wright", "Ingrid Berg", "Samuel Ortiz", "Emma Clarke", "Jones", "Weber",
    "Julia Stein", "Helen O'Neil", "Ravi Patel", "Jean-Paul Girard", "Mary Ann Cole", "Li Wei", "Diaz", "Ahmed Hassan", "Sofia Rossi", "J. R. Miller", "Katarzyna Nowak", "Brown",
)
PHONES = ("(555) 201-3344", "555-0199-2231", "020 7946 0958", "0171 2345678", "(212) 555-0147", "555 014 7788", "415-555-0132", "030 901820", "06 759 2217", "(0)30 1234567", "555-2004", "0800 123 456")
IDS = ("078-05-1120", "X1234567", "219-09-9999", "D123-4567-8901", "00123456789", "DE89370400440532013000", "L8988901C", "AB-123456", "E-20417", "C-99120", "K0012345", "457-55-5462")
ADDRESSES = ("221 Baker Street", "10 Downing Street", "1600 Amphitheatre Drive", "45 Oak Avenue", "7 Mill Road", "350 Fifth Ave", "19 Station Lane", "88 Harbour Rd", "12 Garden Street", "3 Queen St", "104 West End Lane", "27 Cedar Drive")
FILLERS = {"name": NAMES, "tel": PHONES, "id": IDS, "address": ADDRESSES}
#: Sentences with personal data: a kind in brackets stands for a filler of it.
PERSONAL = (
    "Please contact Mr. [name] about the report .", "Dear Mrs [name] , thank you for the letter .", "Signed by Dr. [name] on behalf of the board .", "The patient , Ms. [name] , was seen on Monday .",
    "Name: [name] and the rest of the form is empty .", "Name: [name]", "Sincerely, [name]", "Prof. [name] will speak in the hall .", "Employee name [name] joined in May .", "Miss [name] lives at [address] .",
    "Mr. [name] called at noon .", "Dr [name] and Dr [name] agreed .", "Customer named [name] asked for a refund .", "Contact Mrs. [name] for details .", "We spoke with Mr [name] yesterday .",
    "The letter was signed by Ms [name] in June .", "Dear Mr [name] ,", "A note from Dr. [name] reached us .", "Patient: [name]", "Signed: [name]", "He met Mrs. [name] and Mr. [name] at the station .",
    "Call [tel] before noon .", "Phone: [tel]", "Tel. [tel] is answered daily .", "Mobile: [tel] or fax [tel] .", "Telephone [tel] for help .", "tel: [tel] and ask for Mr. [name] .", "Call Dr. [name] on phone [tel] now .",
    "Fax: [tel]", "Her phone number is [tel] at work .", "You may call me at [tel] .", "Our telephone is [tel] , open from nine to five .", "Phone [tel]", "His mobile is [tel] .",
    "SSN: [id]", "Passport no [id] was issued in Rome .", "His SSN [id] was on the form .", "Licence number: [id]", "Account no. [id] is closed .", "IBAN [id] belongs to the firm .", "Passport: [id]",
    "The id number [id] is wrong .", "Employee id [id] and customer id [id] match .", "Ssn [id] , passport [id] .", "Passport number [id] expired .", "Please quote account number [id] .", "ID: [id]",
    "She lives at [address] with her son .", "Address: [address] , second floor .", "Address: [address]", "He moved to [address] in June .", "Send it to [address] by Friday .", "Address [address] is our office .",
    "They met at [address] at noon .", "Visit [address] for a sample .", "The shop at [address] is open .", "I was born at [address] .", "Mrs. [name] , [address]",
)
#: Ordinary sentences without any.
ORDINARY = (
    "The meeting of the board was on Monday in the hall .", "Table 4 and figure 12 show the total of 2019 .", "Section 3.2 of chapter 7 covers version 2.0 of the guide .",
    "Licensed under the Apache License, Version 2.0.", "Copyright 2020 The Authors. All rights reserved.", "In 1999 the total was 4,500 and in 2004 it was 5,120 .", "THIS NOTICE IS IN CAPITALS !! PLEASE READ IT NOW !!",
    "token = \"9f86d081884c7d659a2feaa0c55ad015\" in the file .", "See page 14 or call the function at line 20 .", "On 12 May 2020 the price was 19.99 in total .", "Read the manual , then press the button 3 times .",
    "| Year | Total | Page | Figure |", "The number of cases was 312 and the number of days was 14 .", "Home About Contact Login Terms", "Accept all cookies to continue reading this page .",
    "Click here to subscribe . Share on social media .", "id 7 and id 9 in the list are free .", "It is 40 km from the sea to the city .", "He came by bus and was at home by nine .", "The card 4539148803436467 was refused .",
    "Rain fell. Roads closed. Trains ran late. By noon the storm had passed.", "Winter came early. The river froze and the ferry stopped. Nobody minded.", "Is it true? Was it ever? Of course it is.",
    "History of the Roman Empire, Volume 2, Chapter 9", "Paris and London are far from Tokyo and Sydney .", "The Prime Minister and the Finance Committee met in Geneva on Tuesday .", "Mix flour , water and salt . Bake for 40 minutes .",
    "Der Zug nach Berlin war am Montag voll. Die Leute waren müde, und der Abend war kalt.", "Die Sitzung beginnt um neun Uhr im Saal. Alle Mitglieder der Kammer sind eingeladen.", "Das Haus an der Ecke ist alt. Im Garten steht ein Baum.",
    "Le train de Paris est en retard. La gare est pleine de monde et il pleut.", "Les enfants jouent dans la cour. Une voiture passe, puis tout est calme.", "La réunion de la commission aura lieu jeudi. Elle sera ouverte au public.",
    "El tren de Madrid llega tarde. La estación está llena y llueve mucho.", "Los niños juegan en la calle. Pasa un coche y todo queda en silencio.", "La reunión del consejo será el jueves. Estará abierta al público.",
    "Stop. Look. Listen. The bridge is open to all.", "SALE!! BUY NOW!! HURRY!! LAST DAY OF THE YEAR!! STOCK IS LOW!! CALL US!!", "WARNING!! DO NOT OPEN!! DANGER OF DEATH!! KEEP OUT!!", "BREAKING: SENATE PASSES BILL AFTER LONG DEBATE, VOTE WAS 51 TO 49", "Call for papers : the deadline is 30 June .", "The phone rang twice and then it was quiet .", "Her address to the nation was short .", "No name was given in the report of the police .",
    "The account of the journey fills 300 pages .", "A number of people signed the letter in March .", "The id of each row is an integer from 1 to 500 .", "Street lights in the old town were replaced in 2018 .", "They drive at night and sleep at noon .",
    "The patient waited at the clinic for 3 hours .", "Dear all , the office is closed on Friday .", "The customer is always right , said the manager .", "Mr. and Mrs. are titles in English .", "The doctor called the ward at noon and left .",
    "Fax machines were common in 1990 .", "tel and phone are words of 3 and 5 letters .", "Employee of the month : nobody .", "Passport control is on the left . Have your papers ready .", "A licence is needed to fish in the lake .",
    "Contact with water must be avoided .", "Sincerely yours , the team of the library .", "Sir , the answer is no .", "Prof. and Dr. stand before names .", "Version 10.4.2 fixes 17 faults of version 10.4.1 .",
    "Go to the corner, turn left at the bank and walk 200 metres .", "&&& *** $$$ ### %%%", "The the the the the the the", "and of and in and to and on and", "0 1 2 3 4 5 6 7 8 9 10", "2020-05-12 14:30:07 INFO started in 350 ms",
)


def labelled_table(times: int = 3) -> tuple[str, ...]:
    """The training lines, spans in brackets with their kind first: every personal sentence with several fillers, then the ordinary ones."""
    turn, out = dict.fromkeys(FILLERS, 0), []

    def fill(m: re.Match) -> str:
        turn[m[1]] += 1
        return f"[{m[1]} {FILLERS[m[1]][turn[m[1]] * 5 % len(FILLERS[m[1]])]}]"

    for _ in range(times):
        out += [re.sub(r"\[(\w+)\]", fill, line) for line in PERSONAL]
    return (*out, *ORDINARY)


#: Lines kept from the training, with other names, numbers and sentences, by which spans are measured.
HELD_OUT = (
    "Yesterday Mr. [name Viktor Lindqvist] opened the new branch .", "Please ask Mrs [name Doris Okafor] for the key .", "Dr. [name Emil Baumann] , of the clinic , agreed .", "Name: [name Teresa Vidal]", "Dear Ms. [name Hughes] , we regret the delay .",
    "The form was signed by Prof. [name Alan Tremblay] in Ottawa .", "Miss [name Zoe Marchetti] rents the flat at [address 14 Elm Street] .", "Call [tel (555) 884-1029] after six .", "Tel: [tel 0161 496 0735]", "Our fax is [tel 555-7710] , and the phone is [tel 020 7946 0011] .",
    "Mobile [tel 0176 5554433] works on weekends .", "Passport no. [id P7654321] is valid until May .", "SSN [id 512-44-9087] was entered twice .", "Account number: [id 00998877665]", "Employee id [id E-77120] has left the firm .", "IBAN: [id FR7630006000011234567890189]",
    "Address: [address 5 Orchard Road] , ground floor .", "He lives at [address 301 Maple Avenue] near the park .", "Please send the parcel to [address 62 Church Lane] today .", "Licence no [id G882-1190-4471] belongs to Mr. [name Farouk Aziz] .",
    "The concert begins at eight in the town hall .", "Snow fell on Oslo. Schools closed. Buses stayed in the depot.", "Figure 3 on page 21 shows 4 of the 12 cases .", "The committee of the Northern Region met in Leeds on Thursday .", "Open the door , count to 10 and call the lift .",
    "Die Brücke über den Fluss wird im Sommer gesperrt. Der Umweg ist lang.", "Le marché du village ouvre à huit heures. Il y a du pain et des fleurs.", "El puente sobre el río se cierra en verano. La gente protesta.", "Chapter 12 . The Return of the Fleet", "The address of the president lasted 50 minutes .",
    "In 2011 the street was paved and 40 trees were planted .", "A name is missing on line 6 of the table .", "Press 1 for English or 2 for Spanish .", "The doctor said the account was closed in 2015 .", "Read more : Terms of Service , Privacy Policy , Contact",
)


def parse_labelled(line: str) -> tuple[str, list[int]]:
    """Text and tag numbers of its tokens."""
    text, tags = [], []
    for m in re.finditer(r"\[(\w+) ([^\]]+)\]|[^\s\[\]]+", line):
        pieces = m[2].split() if m[1] else [m[0]]
        for i, piece in enumerate(pieces):
            text.append(piece)
            tags.append(TAGS.index(f"{'I' if i else 'B'}-{m[1]}") if m[1] else 0)
    return " ".join(text), tags


@dataclass(frozen=True)
class Chain:
    """Weights: emissions of the token's own, the previous and the next shape; transitions; starts."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, shape: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Scores (token, tag). ``opens`` marks the first token of each sequence."""
        distinct, which = np.unique(shape, return_inverse=True)
        rows = unpack(distinct)
        own, before, after = (w[rows].sum(axis=1).astype(np.float32)[which] for w in (self.own, self.before, self.after))
        out = own
        inside = ~opens[1:]
        out[1:][inside] += before[:-1][inside]
        out[:-1][inside] += after[1:][inside]
        out[opens] += self.first
        return out

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of all sequences side by side; ``starts`` and ``lengths`` cut ``scores`` into them."""
        tags = np.zeros(len(scores), dtype=np.int8)
        if not len(starts):
            return tags
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        moves = self.moves.astype(np.float32)
        back = np.zeros((len(scores), len(TAGS)), dtype=np.int8)
        best = scores[starts].copy()
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences longer than step
        for step in range(1, lengths[0]):
            n = alive[step]
            reach = best[:n, :, None] + moves
            back[starts[:n] + step] = reach.argmax(axis=1)
            best[:n] = reach.max(axis=1) + scores[starts[:n] + step]
        at = best.argmax(axis=1)
        for step in range(lengths[0] - 1, -1, -1):
            n = alive[step]
            here = starts[:n] + step
            tags[here] = at[:n]
            at[:n] = back[here, at[:n]]
        return tags


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(labelled: tuple[str, ...] | None = None, steps: int = 150, rate: float = 0.1, ridge: float = 0.02) -> Chain:
    """Maximum likelihood with Gaussian weights: forward-backward over all lines at once, Adam steps. Deterministic."""
    parsed = [parse_labelled(x) for x in labelled or labelled_table()]
    most, k = max(len(t) for _, t in parsed), len(TAGS)
    feature = np.full((len(parsed), most, len(SIZES)), ROWS)  # row ROWS has weight 0
    gold = np.full((len(parsed), most), -1)
    for i, (text, tags) in enumerate(parsed):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        feature[i, : len(tags)] = unpack(shapes(codes, *tokens_of(codes)))
        gold[i, : len(tags)] = tags
    inside = gold >= 0
    pad = np.full((len(parsed), 1, len(SIZES)), ROWS)
    previous, following = np.concatenate([pad, feature[:, :-1]], 1), np.concatenate([feature[:, 1:], pad], 1)
    theta = [np.zeros((ROWS + 1, k)), np.zeros((ROWS + 1, k)), np.zeros((ROWS + 1, k)), np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    hot = np.eye(k)
    for step in range(1, steps + 1):
        own, before, after, moves, first = theta
        score = own[feature].sum(2) + before[previous].sum(2) + after[following].sum(2)
        score[:, 0] += first
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, most):
            moved = _log_sum(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
            forward[:, t] = np.where(inside[:, t, None], moved, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            moved = _log_sum(moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], moved, 0)
        whole = _log_sum(forward[:, -1], 1)
        chance = np.exp(forward + backward - whole[:, None, None]) * inside[:, :, None]
        error = np.where(inside[:, :, None], hot[np.maximum(gold, 0)] - chance, 0)
        grads = [np.zeros_like(x) for x in theta]
        for grad, rows in zip(grads[:3], (feature, previous, following), strict=True):
            np.add.at(grad, rows, error[:, :, None, :])
            grad[ROWS] = 0
        for t in range(1, most):
            use = inside[:, t]
            pair = np.exp(forward[use, t - 1, :, None] + moves + (score[use, t] + backward[use, t])[:, None, :] - whole[use, None, None])
            grads[3] -= pair.sum(0)
            np.add.at(grads[3], (gold[use, t - 1], gold[use, t]), 1)
        grads[4] = error[:, 0].sum(0)
        for i, grad in enumerate(grads):
            grad = grad - ridge * theta[i]
            m1[i] = 0.9 * m1[i] + 0.1 * grad
            m2[i] = 0.99 * m2[i] + 0.01 * grad**2
            theta[i] = theta[i] + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    return Chain(*theta)


#: What a span of a kind must look like: names are up to five words of letters and the marks of names, with stops behind initials and short titles only; all else holds a digit.
NAME = re.compile(r"[^\W\d_]['’.\-\s\w]*")


def plausible(kind: str, text: str) -> bool:
    """Whether the text of a span can be of its kind at all."""
    digit = any("0" <= c <= "9" for c in text)
    if kind != "name":
        return digit
    words = text.split()
    return bool(NAME.fullmatch(text)) and not digit and len(words) <= 5 and all(len(w) <= 4 for w in words[:-1] if w.endswith("."))


#: Code points decoded in one batch; a longer line is a batch of its own.
BATCH = 1_000_000


def chain_spans(chain: Chain, codes: np.ndarray) -> list[Span]:
    """Labelled spans of one array of code points, in order of start."""
    starts, ends = tokens_of(codes)
    if not len(starts):
        return []
    line = np.cumsum(codes == 10)[starts]
    opens = np.r_[True, line[1:] != line[:-1]]
    scores = chain.emissions(shapes(codes, starts, ends), opens)
    at = np.flatnonzero(opens)
    tags = chain.viterbi(scores, at, np.diff(np.r_[at, len(starts)]))
    begins = np.flatnonzero(tags % 2 == 1)
    found = []
    for i in begins:
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and not opens[j]:
            j += 1
        start, end = int(starts[i]), int(ends[j - 1])
        while end > start + 1 and chr(codes[end - 1]) in ".,;:!?|":
            end -= 1
        found.append((LABELS[tags[i] // 2], start, end))
    return found


def added_spans(chain: Chain, texts: list[str]) -> list[list[Span]]:
    """Spans that the chain finds in each whole text; texts are decoded together up to BATCH code points, longer ones in parts cut at line ends."""
    out: list[list[Span]] = [[] for _ in texts]
    queue: list[tuple[int, int, str]] = []

    def flush() -> None:
        joined = "\n".join(t for _, _, t in queue)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        borders = np.cumsum([0, *(len(t) + 1 for _, _, t in queue)])
        for kind, start, end in chain_spans(chain, codes):
            if not plausible(kind, joined[start:end]):
                continue
            n = int(np.searchsorted(borders, start, side="right")) - 1
            i, shift, _ = queue[n]
            out[i].append((kind, start - int(borders[n]) + shift, end - int(borders[n]) + shift))
        queue.clear()

    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = min(len(text), at + BATCH)
            if stop < len(text):
                gap = text.rfind("\n", at, stop)
                gap = gap if gap >= 0 else text.find("\n", stop)
                stop = gap + 1 if gap >= 0 else len(text)
            if size + stop - at > BATCH and queue:
                flush()
                size = 0
            queue.append((i, at, text[at:stop]))
            size += stop - at
            at = stop
    if queue:
        flush()
    return out


ORDER = {k: n for n, k in enumerate((*KINDS, *sorted(LABELS)))}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ORDER[x[0]], x[1])))


def find_personal_data(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per document: base spans (fixed patterns) and added spans (the chain), as text ``kind:start:end,...``.

    Null texts count as empty and have no spans; texts are searched whole,
    however long; repeated rows are treated alike; columns besides doc_id and
    text are ignored; an empty table gives no rows. An added span that overlaps
    a base span of its text is dropped.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            bases = [base_spans(t) for t in texts]
            added = []
            for base, extra in zip(bases, added_spans(chain, texts), strict=True):
                added.append([x for x in extra if all(x[2] <= b[1] or b[2] <= x[1] for b in base)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": [joined(b) for b in bases], "added": [joined(a) for a in added]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(find, f"doc_id {kind}, base string, added string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), train())
    counts = [f"CAST(regexp_count(base, '(^|,){k}:') AS BIGINT) AS n_{k}" for k in KINDS]
    return found.selectExpr("doc_id", *counts, "sha2(base, 256) AS base_sha256", "concat_ws(',', nullif(base, ''), nullif(added, '')) AS spans")


def quality(chain: Chain, lines: tuple[str, ...] = HELD_OUT) -> tuple[float, float]:
    """Precision and recall of whole spans (kind, start and end) on labelled lines."""
    found, right, there = 0, 0, 0
    for line in lines:
        text, _ = parse_labelled(line)
        got = [(k, text[a:b]) for k, a, b in added_spans(chain, [text])[0]]
        want = re.findall(r"\[(\w+) ([^\]]+)\]", line)
        found, right, there = found + len(got), right + sum(x in want for x in got), there + len(want)
    return right / max(1, found), right / max(1, there)
