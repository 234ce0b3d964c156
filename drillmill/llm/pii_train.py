"""Learns the chain weights of pii.py from generated, labelled sentences: python -m drillmill.llm.pii_train.

Sentences are made from patterns with slots; the slots' texts are labelled. SENTENCES bounds the sample. Patterns and slot texts are about
homes, wards, offices and deliveries at large; neither wording, names, hosts nor number shapes are taken from any table of this
project. Every fourth pattern is never trained on: the held-out figures are for those.
"""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np

from drillmill.llm.pii import COMMON_GIVEN, LABELS, TYPES, Crf, features, read_lexicon

SENTENCES, EPOCHS, SEED = 14000, 6, 7
#: Share of the features that name a word that a training step leaves out.
DROP = 0.35
HELD_OUT = 1500

SURNAMES = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts O'Connor O'Brien McDonald Kowalski Müller Schröder Åberg Petrović Yılmaz Okafor Mbeki Tanaka Suzuki Chen Wang Kim Park Singh Patel Hussain Cohen Rossi Ferrari Dubois Lefèvre Silva Santos Costa Novak Horvat".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Court Ct Place Pl Terrace Ter Boulevard Blvd Way Circle Square Parkway Trail Crescent".split()
THINGS = "Deputy Fire Police Water Power Willow Pine Aspen Poplar Chestnut Magnolia Ivy Tulip Daisy Olive Lemon Copper Granite Lower Upper Old New Sunny Garden Rose Willow Harbor River Summit Sunset Quality City County State North East Main Blue Silver Trades Nursing Dental Finance Autumn Holiday Weekend Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Spring Winter Emergency Medication Transport Kitchen Boiler Elevator Parking Visitor Staff Resident Family Community Senior Youth Annual Monthly Safety Health Program Service".split()
PLACES = "Newsletter Bulletin Circular Poster Inspector Director Manager Sheriff Warden Marshal Captain Foyer Nook Atrium Cellar Attic Porch Patio Corridor Stairs Pond Library Bench Room Suite Annex Parlor Floor Tower Center Clinic Bakery Deli Pharmacy Handbook Manual Notice Committee Council Department Office Desk Team Plan Policy Form Log Report Schedule Bus Van Elevator Garage Gate Entrance Chapel Hospital School Works Supply Services Company Inc. Co. Day Meeting Review Fair Market Park Field Bridge Station Unit".split()

POSITIVE = """{N} arrived late and sat by the window.
{N} asked for a copy of the minutes.
{N} refused lunch but drank some juice.
{N} did not want to get into the car.
{N} could not find the key to the shed.
{N} slept badly, so the nurse stayed until six.
{N} should see the dentist before Easter.
{N} was the first to reach the parking lot.
{N} and {G} played cards until ten.
{N} came to visit with {G}.
{N} walked to church with {G} from next door.
{N} got along well with {G} from the second floor.
{R} was asleep in the chair.
{N} returned from {S} on Friday and was tired.
{N} lives at {S} with two cousins.
{N} grew up near {S}, as the file says.
{N}'s glasses were broken; a spare pair was found.
{N}'s bus pass had expired.
{G}'s coat was left in the taxi.
{N}, {L}, is on the list for surgery.
{N}, {L}, has a new key worker.
{N} ({E}) would like a reply by Monday.
{N} {E_in} asked about the bill.
{N} ({L}) has moved to another ward.
{G} and {G} shared a table at breakfast.
{G}, {G} and {G} sang in the choir.
{G} went to the library alone.
{G} said that the lift was too loud.
{G} needed two people to stand up.
Later {G} helped with the dishes.
{G} took a nap after lunch.
{G} opened the window twice.
{G} was cold and wanted a coat.
{G} left early with the driver.
{G} took the bus and paid alone.
{G} held the cup with both hands.
{U} WAS SEEN NEAR THE BACK GATE.
{U} CALLED TWICE AND HUNG UP.
{U} FELL IN THE SHOWER.
{UL} - resting, not to be disturbed
{UL}: no visitors today
{T} {Z} locked the office at nine.
{T} {Z} signed for the parcel.
{T} {Z} explained the new rota.
{T} {N} will chair the meeting.
We thanked {T} {Z} for the cake.
{T} {Z} carried the bags upstairs.
{T} {Z} opened the side gate.
{T} {Z} kept watch by the stove.
{T} {Z} took the call from the clinic.
{T} {Z} was on duty.
The daughter of {N} wrote back the same day.
A friend of {N} waits at the gate.
asked {W} to sit down and wait
told {W} that the doctor was delayed
saw {W} near the lockers, all well
helped {W} with the zip of the coat
Written by {I}.
Checked: {I}
Initials and name: {I}.
Approved by {I}, charge nurse.
Medication was given by {NI}, LPN, at noon.
Blood pressure taken per {NI}, RN, in bed.
Reported by {N} and a volunteer.
Carried out by {N} with one temp.
Interview with {N} lasted an hour.
The mother of {N} rang at {P} after dinner.
Brother of {N} left his number: {P}.
The lawyer of {N} will ring {P} tomorrow.
Spoke to {N} about the invoice.
Met {N} and {N} in the lobby.
Please contact {N} at {P} or {E}.
Questions go to {N}, {E}.
Landlord: {N}, {S}, {P}
For plumbing ask {P} or {E}
Plumber: {P} / {E}
Scans are with {E} since noon.
The minutes were mailed to {E} too.
A copy went to {E} by accident.
E-mail {E} for the menu.
Her address is {E}, she says.
The form for {L} reached {E} instead of the clinic.
Card in the wallet reads {L}; returned.
Found a badge with {L}, handed in at the desk.
The label on the coat had {L}, cut out.
The file lists {L}; home phone {P}.
Chart shows {L}; next of kin {P}.
Patient gave {L} at the counter.
{R} missed the appointment.
{R} did not take part.
{R} - transferred to room nine
{R}; {L}; allergic to nuts
Emergency contact: {S}, phone {P}.
Parcel for {S} was left next door.
The picnic moved to {S} because of rain.
The bus brought everyone to {S} and waited.
Everyone met at {S} before noon.
A man from {S} was angry about the noise.
We parked near {S}, opposite the bakery.
Owner of {S} wants the hedge cut.
Voicemail from {P}, no name.
tel {P}
ph. {P}
call back {P}
mobile: {P}
fax {P}
Night desk answers on {P} until seven.
Ring {P} when the boiler stops.
Call {P} before noon.
Call or text {P}.
Landlord at {S}, tel. {P}.
tel. {P}.
Lifted by {N} and one temp.
Driven home by {N} and a neighbor.
Washed by {N}, one aide looked on.
{G}, {G} and a cousin came last.
Car took both to {S} after lunch.
Ambulance brought them to {S}.
{A} carries {L}.
{A} with {L} went to the office; mobile {P}.
{UL} - fed, changed at four
{R} would rather stay in.
{R} could not be woken.
{G} and {G} sat down last.
The company is at {P} all week.""".split("\n")
NEGATIVE = """Radiator valve loose; {d} turns needed.
{C} {C} {d} was cleaned twice.
The {C} {C} closes at {d}:{d2}.
{C} {C} rang about order {d6}, ready on {C}.
Receipt {d7} from {C} {C} is in the drawer.
Bill {d6} of the {C} {C} was paid.
Meter reading {d8}, checked at {d}:{d2}.
Spare part {d8}-{d} arrived; box {c}{d2}-{d3}.
Ticket {c2}-{d6} is still open.
House account {d6} was on hold until {d}:{d2}.
Order {d6} for {d} chairs went out.
Pump {c2}-{d4} leaks; two screws missing.
Serial number {d4}-{d4}-{d} noted for the warranty.
Lot {d8}, best before {d2}/{d4}.
See page {d} of the {C} {C}.
Version {d}.{d}.{d} of the plan is on the wall.
Shelf {c}{d2}-{d3} is full.
Gate {d} by {C} {C} stayed shut.
Chairs from {C} {C} and {C} {C} are in the hall.
Someone sat near {C} {C} until noon.
They went past {C} {C} fence to the pond.
Waited at {C} {C} with {d} others.
Door {d} next to {C} {C} is for deliveries.
Taxi {d} came at {d}:{d2}, engine running.
Nobody used the {C} {C} this week.
Lights in the {C} {C} flicker.
Two walkers were left by the {C} {C} door.
The fridge showed {d} degrees at {d}:{d2}:{d2}.
Keypad code {d4} was changed on {C}.
Window {d} rattles; tape put on.
Toilet on floor {d} blocked; cleared the same evening.
Please wipe the {C} table after soup.
Someone left a scarf in seat {d}.
Slow morning, but all meals were out by {d}:{d2}.
People sat in the {C} {C} and waited for the rain to stop.
Wheelchairs go first, then those who walk.
{d} persons counted, all present.
Everybody was back before the soup got cold.
Practise folding the blankets next time.
Hot water was off for {d} minutes; fixed.
Some residents found the music too loud.
Kitchen timer is {d} minutes slow.
Staff checked the {C} {C} and the {C} room.
Hours are written in minutes.
Weights are given in pounds.
(by kitchen scale)
All well.
Nothing to report.
none
sat up in bed
ate well
two cups of tea
needs a spoon
uses a cane
slept until noon
did not want soup, then ate
arm in arm
chair to bath, {d} helpers
lift, {d} helpers
sang along
NO POST TODAY.
DOOR LEFT OPEN AGAIN.
LUNCH WAS COLD BUT EVERYONE ATE.
Fax paper is low; {d} rolls left.
Alarm tested, horn heard on floor {d}.
Extinguisher in the {C} {C} is due; tag {c}{d2}-{d3}.
Model {c2}-{d4} lamps to be ordered; {d} pieces.
Clock stopped at {d}:{d2}; new battery.
Inspector of the {C} {C} came and left a card.
Walked round the block in {d} minutes.
One person rested on step {d}, took the rail.
Snow on the path; sand spread at {d}:{d2}.
Car {d} blocked the ramp for a while.
Bell {d} was heard twice.
Group came back by the side street and waited at the fence.
Test of zone {d} was fine.
Bus took everyone home at {d}.
Car took them to the {C} {C}.
{C} {C} {C} {d} hangs beside the clock.
{C} {C} {C} {d} was read out.
Radio {d} is broken, use the other.
Second round after tea, {d} people more.
Fire engine {d} passed the house, not for us.
Storm took the sign of {C} {C} down.
Reprinted the sheet for the {C} {C}.
Rear door sticks, handle greased.
Phase {d} of the {C} {C} begins in {C}.
{O} {Q} {d7} is on the shelf.
{O} {Q} {d8}-{d} was sent back.
{O} {Q} {d6} for {C} {C} and {C} was filed.
New {o} ordered, {O} {Q} {d6}.
{A} was empty again.
{A} on floor {d} squeaks; oil it.
{A} in the {C} {C} needs a lamp.
{A} shows {d6}; {o} {d} replaced.
{A} and {o} checked by the {C} {C}.
{A} matched the list, {o} {d} was free.
{A} rug or mat to be taped.
{A} fell down; put back on {C}.
{B} door stays shut at night.
{B} light was on, the {b} was empty.
{B}, pen and torch are on the hook.
with {b}
with a {b} and a {o}
no {b} today
the {b} was late, {o} used
pushes the {b}
{C} team was on duty, {b} open.
Hours shown by the {o}, {C} shift in charge.
{C} {C} and {B} sent a bill.
Receipt {d6} for {M} filed.
Bill {d7} from {M} paid.
{M} will come on {C}.
Work by {M}, guarantee {d} years.
{M} fixed the {o}, order {d6} closed.
Card of {M} left at the desk.
Bring the {b}; the {o} is broken.
Kept the {C} {C} and the {B} {C} locked.""".split("\n")
#: Things of a house, many of them words that the lexicon doesn't hold; words that are surnames as well; what is numbered but isn't a person.
ARTICLES = "wheelbarrow dishwasher doorbell stairwell bathmat whiteboard armchair thermostat nightlight clipboard sprinkler hydrant handrail hallway bedspread tablecloth headphones dustpan hairdryer lampshade keyring floorboard doorstop toolbox earplugs bookshelf washcloth towelrail windowsill footrest headrest wristwatch armrest walkway driveway lawnmower flashlight smokehood megaphone whistle lanyard stretcher defibrillator ventilator humidifier radiator dehumidifier vacuum freezer toaster kettle beeper buzzer siren strobes projector loudspeaker intercom deadbolt hinge latch gasket fuse breaker caulk grout valve spigot faucet gurney commode hoist sling".split()
SURNAME_WORDS = "walker baker hall hill key king park young long brown white green black gray bell cook price rose bush woods field stone church banks wall fields wood marsh lane ford cross day winter may bird fox wolf lamb carpenter mason porter page gardener butler barber shepherd driver parson".split()
TRADES = "Glass Lock Plumbing Roofing Paint Tile Timber Heating Electric Carpet Tool Gas Door Signal Cleaning Laundry Catering Print Moving Window".split()
NUMBERED = "part invoice order account serial lot batch model room ticket receipt meter bill policy tag panel pump case file shelf".split()
ASIDES = ("ate well", "uses a cane", "sat up in bed", "needs a spoon", "sang along", "arm in arm", "two cups of tea", "lift, 2 helpers", "did not want soup, then ate", "slept until noon")
ID_LABELS = "SSN|SSN:|social security no.|social|soc. sec. no.|passport|passport no.|driver's license|driver license|license no.|DL#|DL no.|Medicaid no.|Medicaid ID|medicare #|member ID|member no.|patient ID|patient no.|MRN|MRN:|client no.|client ID|resident ID|resident no.|case ID|case no.|employee no.|student ID|insurance no.|tax ID|CIN|TABS|TABS ID|tabs #".split("|")


def split_patterns(patterns: list[str], held_out: bool) -> list[str]:
    return [p for k, p in enumerate(patterns) if (k % 4 == 3) == held_out]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = sorted(x.capitalize() for x in COMMON_GIVEN)

    def invented(self) -> str:
        """A word of two or three open syllables, with an ending now and then."""
        r = self.r
        w = "".join(r.choice(("b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "ch", "dr", "gr", "kl", "pr", "sch", "st", "th", "tr")) + r.choice("aeiouyaeiouöü" if r.random() < 0.1 else "aeiou") + r.choice(("", "", "n", "r", "l", "s", "t")) for _ in range(r.choice((2, 2, 2, 3))))
        return (w + r.choice(("", "", "n", "s", "ck", "rd", "nd", "ll", "tz", "m"))).capitalize()

    def short(self) -> str:
        """Three or four letters."""
        v = "aeiou"
        return "".join(self.r.choice(x) for x in self.r.choice(((v, "dlmnrst", v), ("bdjklmnrt", v, "nlmx"), ("bdjklmnrt", v, v), ("bdhjklmnr", v, "dglmnrs", v), (v, "mlnr", v, "lnr")))).capitalize()

    def surname(self) -> str:
        return self.r.choice(SURNAMES) if self.r.random() < 0.3 else self.invented()

    def first(self) -> str:
        x = self.r.random()
        return self.r.choice(self.given) if x < 0.6 else self.invented() if x < 0.85 else self.short()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def name(self) -> str:
        g, s, x = self.first(), self.surname(), self.r.random()
        return f"{g} {s}" if x < 0.65 else f"{g[0]}. {s}" if x < 0.77 else f"{s}, {g}" if x < 0.83 else f"{g} {self.letters(1)}. {s}" if x < 0.9 else f"{g} {s}-{self.surname()}" if x < 0.92 else s

    def phone(self) -> str:
        r = self.r
        a, b, x = str(r.randrange(200, 1000)), str(r.randrange(200, 1000)), self.digits(4)
        sep = r.choice((" ", "-", ".", ""))
        area = r.choice((f"({a}) ", f"({a})", a + sep, a + sep))
        p = r.choice(("", "", "", "", "+1 ", "1-", "1 ", "+1-")) + area + b + (sep if area[0] != "(" else r.choice("- ")) + x if r.random() < 0.9 else f"{b}-{x}"
        return p + r.choice(("", "", "", "", f" ext. {r.randrange(1, 1000)}", f" x{r.randrange(1, 1000)}", f", ext {r.randrange(10, 100)}"))

    def email(self) -> str:
        r = self.r
        g, s = self.first().lower(), re.sub(r"[^a-z]", "", self.surname().lower()) or "info"
        user = r.choice((f"{g}.{s}", f"{g}_{s}", f"{s}.{g}", f"{g}-{s}", f"{g[0]}{s}", f"{s}{g[0]}", f"{g}{r.randrange(100)}", f"{s}+news", s))
        host = self.invented().lower() + r.choice(("", "", "-" + self.invented().lower(), "." + self.invented().lower()))
        end = r.choice(("com", "org", "net", "edu", "gov", "info", "co.uk", "example", "test", "invalid"))
        x = r.random()
        mail = f"{user}@{host}.{end}" if x < 0.7 else f"{user}[at]{host}.{end}" if x < 0.78 else f"{user} (at) {host}.{end}" if x < 0.84 else f"{user} at {host} dot {end}".replace(".", " dot ") if x < 0.95 else f"{user} at {host}.{end}"
        return mail.upper() if r.random() < 0.06 and "@" in mail else mail

    def id_number(self) -> tuple[str, str]:
        r = self.r
        shape = r.choice(("d", "d", "-", " ", "A", "B", "C", "ssn", "ssn"))
        if shape == "ssn":
            v = r.choice(("{}-{}-{}", "{} {} {}", "{}{}{}", "{} {}{}")).format(self.digits(3), self.digits(2), self.digits(4))
        elif shape == "d":
            v = self.digits(r.randrange(5, 11))
        elif shape in "- ":
            v = shape.join(self.digits(r.choice((3, 3, 4))) for _ in range(r.choice((2, 3))))
        elif shape == "A":
            v = f"{self.letters(r.randrange(1, 3))}{r.choice(('', '-'))}{self.digits(r.randrange(5, 9))}"
        elif shape == "B":
            v = f"{self.letters(r.randrange(1, 3))}{self.digits(r.randrange(4, 7))}{self.letters(1)}"
        else:
            v = f"{self.digits(r.randrange(4, 8))}{self.letters(1)}"
        return r.choice(ID_LABELS), v

    def street(self) -> str:
        r = self.r
        words = self.invented() if r.random() < 0.7 else r.choice(("Oakwood", "Main", "Church", "Park View", "Old Mill", "Second", "Washington", "Lincoln", "Spring Hill"))
        s = f"{r.randrange(1, 3000)} {r.choice(('', '', '', '', 'N. ', 'S ', 'West '))}{words} {r.choice(STREETS)}"
        n = r.randrange(1, 30)
        return s + r.choice(("", "", "", f" Apt {n}", f" Unit {n}", f" #{n}", f", Apt {n}{r.choice('ABCD')}", f", Suite {n}", f" Apt. {n}{r.choice('ABC')}"))

    def slot(self, key: str) -> list[tuple[str, str]]:
        """Pieces of (text, type or empty)."""
        r, person = self.r, "PERSON_NAME"
        made = {
            "N": lambda: [(self.name(), person)], "NI": lambda: [(r.choice((g := self.first(), g[0] + ".")) + " " + self.surname(), person)],
            "I": lambda: [(f"{self.letters(1)}. {self.surname()}" if r.random() < 0.7 else self.name(), person)], "G": lambda: [(self.first(), person)],
            "R": lambda: [(f"{self.surname()}, {self.first()}", person)], "Z": lambda: [(self.surname(), person)], "U": lambda: [(f"{self.first()} {self.surname()}".upper(), person)],
            "UL": lambda: [(self.surname().upper(), person)], "W": lambda: [(f"{self.first()} {self.surname()}".lower(), person)],
            "T": lambda: [(r.choice(("Mr.", "Ms.", "Mrs.", "Mx.", "Dr.", "Nurse", "Supervisor", "Mr", "Ms", "Miss", "Prof.", "Officer")), "")],
            "P": lambda: [(self.phone(), "PHONE")], "E": lambda: [(self.email(), "EMAIL")], "E_in": lambda: [("(", ""), (self.email(), "EMAIL"), (")", "")], "S": lambda: [(self.street(), "STREET_ADDRESS")],
            "L": lambda: [((x := self.id_number())[0] + " ", ""), (x[1], "ID_NUMBER")], "c": lambda: [(self.letters(1), "")], "c2": lambda: [(self.letters(2), "")],
            "A": lambda: [(r.choice(ARTICLES).capitalize(), "")], "o": lambda: [(r.choice(ARTICLES), "")], "B": lambda: [(r.choice(SURNAME_WORDS).capitalize(), "")], "b": lambda: [(r.choice(SURNAME_WORDS), "")],
            "M": lambda: [(f"{r.choice((r.choice(THINGS), self.invented()))} {r.choice(TRADES)} {r.choice(('and', 'and', '&'))} {r.choice((*TRADES, *SURNAME_WORDS)).capitalize()}{r.choice(('', '', ' Co.', ' Inc.'))}" if r.random() < 0.7 else f"{r.choice(THINGS)} {r.choice(TRADES)} {r.choice(PLACES)}", "")],
            "O": lambda: [(r.choice(NUMBERED[:-2]).capitalize(), "")], "Q": lambda: [(r.choice(("no.", "no.", "number", "#", "nr.")), "")],
            "C": lambda: [(r.choice((r.choice(THINGS), r.choice(PLACES), self.invented())) if r.random() < 0.9 else r.choice(self.given), "")],
        }
        if key in made:
            return made[key]()
        n = int(key[1:] or 0)
        return [(self.digits(n) if n > 2 else f"{r.randrange(60):02d}" if n == 2 else str(r.randrange(2, 25)), "")]

    def sentence(self, pattern: str) -> tuple[str, list[tuple[str, int, int]]]:
        text, spans = "", []
        pattern = re.sub(r"\{C\} \{C\}", lambda m: f"{self.r.choice(THINGS)} {self.r.choice(PLACES)}" if self.r.random() < 0.75 else m[0], pattern)
        if self.r.random() < 0.12:
            text = self.r.choice(ASIDES) + self.r.choice(("; ", " - "))
        for piece in re.split(r"(\{\w+\})", pattern):
            if re.fullmatch(r"\{\w+\}", piece):
                for t, kind in self.slot(piece[1:-1]):
                    if kind:
                        spans.append((kind, len(text), len(text) + len(t)))
                    text += t
            else:
                text += piece
        return text, spans


def labelled(text: str, spans: list[tuple[str, int, int]], lexicon: dict[str, str]) -> tuple[list[list[str]], np.ndarray]:
    offsets, feats = features(text, lexicon)
    y = np.zeros(len(offsets), np.int64)
    for kind, a, b in spans:
        first = True
        for k, (s, e) in enumerate(offsets):
            if s >= a and e <= b:
                y[k] = LABELS.index(f"{'B' if first else 'I'}-{kind}")
                first = False
    return feats, y


def train(data: list[tuple[list[list[str]], np.ndarray]]) -> Crf:
    """Maximum likelihood by AdaGrad on whole sentences, features as rows of one matrix."""
    index: dict[str, int] = {}
    rows = [([np.array([index.setdefault(f, len(index)) for f in fs]) for fs in feats], y) for feats, y in data if len(y)]
    weights, squares = np.zeros((len(index), len(LABELS))), np.full((len(index), len(LABELS)), 1e-3)
    trans = np.zeros((len(LABELS), len(LABELS)))
    trans_sq = np.full_like(trans, 1e-3)
    for j, to in enumerate(LABELS):  # an I follows only its own type
        for i, fro in enumerate(LABELS):
            if to[0] == "I" and fro[2:] != to[2:]:
                trans[i, j] = -8.0
    rng, draw = random.Random(SEED), np.random.default_rng(SEED)
    # features that name words are dropped at random, so that no word alone decides
    wordy = np.array([f[0] in "wpn" or f[:2] in ("kp", "kn") for f in index])
    mean, mean_trans = np.zeros_like(weights), np.zeros_like(trans)
    for epoch in range(EPOCHS):
        rng.shuffle(rows)
        if epoch > 1:
            mean += weights / (EPOCHS - 1)
            mean_trans += trans / (EPOCHS - 1)
        for whole, y in rows:
            n = len(y)
            feats = [f[~wordy[f] | (draw.random(len(f)) > DROP)] for f in whole]
            u = np.array([weights[f].sum(0) for f in feats])
            t, e = np.exp(trans), np.exp(u - u.max(1, keepdims=True))
            a, b = np.zeros_like(e), np.ones_like(e)
            a[0] = e[0] * t[0]
            a[0] /= a[0].sum()
            for k in range(1, n):
                a[k] = (a[k - 1] @ t) * e[k]
                a[k] /= a[k].sum()
            for k in range(n - 2, -1, -1):
                b[k] = t @ (b[k + 1] * e[k + 1])
                b[k] /= b[k].sum()
            g = -(a * b)
            g /= -g.sum(1, keepdims=True)
            g[np.arange(n), y] += 1
            for k in np.flatnonzero(np.abs(g).max(1) > 1e-3):
                f = feats[k]
                squares[f] += g[k] ** 2
                weights[f] += 0.25 * g[k] / np.sqrt(squares[f]) - 2e-4 * weights[f]
            gt = np.zeros_like(trans)
            for k in range(1, n):
                pair = np.outer(a[k - 1], e[k] * b[k]) * t
                gt -= pair / pair.sum()
                gt[y[k - 1], y[k]] += 1
            trans_sq += gt**2
            trans += 0.1 * gt / np.sqrt(trans_sq)
    mean += weights * (1 - max(0, EPOCHS - 2) / (EPOCHS - 1))
    mean_trans += trans * (1 - max(0, EPOCHS - 2) / (EPOCHS - 1))
    return Crf({f: mean[k] for f, k in index.items()}, mean_trans)


def sample(n: int, seed: int, held_out: bool = False) -> list[tuple[str, list[tuple[str, int, int]]]]:
    maker = Maker(seed)
    kinds = split_patterns(POSITIVE, held_out), split_patterns(NEGATIVE, held_out)
    return [maker.sentence(maker.r.choice(kinds[maker.r.random() >= 0.6])) for _ in range(n)]


def pack(crf: Crf) -> dict:
    out = {}
    for f, w in sorted(crf.weights.items()):
        kept = {str(k): round(float(v), 2) for k, v in enumerate(w) if abs(v) >= 0.1}
        if kept:
            out[f] = kept
    return {"labels": LABELS, "types": TYPES, "weights": out, "trans": [[round(float(v), 2) for v in row] for row in crf.trans]}


def score(tagger, data: list) -> dict[str, tuple[int, int, int]]:
    """type -> (spans right, spans found, spans there)."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for text, spans in data:
        got, want = set(tagger.find(text)), set(spans)
        for at, part in enumerate((got & want, got, want)):
            for kind, _, _ in part:
                out[kind][at] += 1
    return {k: tuple(v) for k, v in sorted(out.items())}


def main() -> None:
    from drillmill.llm.pii import Tagger

    lexicon = read_lexicon()
    crf = train([labelled(*x, lexicon) for x in sample(SENTENCES, SEED)])
    path = Path(__file__).with_name("pii_weights.json")
    path.write_text(json.dumps(pack(crf), ensure_ascii=False, separators=(",", ":")))
    for kind, (right, found, there) in score(Tagger(Crf.load(path), lexicon), sample(HELD_OUT, SEED + 1, held_out=True)).items():
        print(f"{kind}: precision {right / found:.3f}, recall {right / there:.3f} of {there} on patterns that were held out")
    print(f"{path.stat().st_size / 1e3:.0f} kB")


if __name__ == "__main__":
    main()
