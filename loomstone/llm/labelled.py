"""The small labelled table the tagger of personal data is trained from.

A line holds text with slots: ``{name}``, ``{email}``, ``{phone}``, ``{id}`` and
``{address}`` are labelled items, the others look alike but are none.  Slots are filled by rule from
syllables with a fixed seed.
"""

from __future__ import annotations

import random
import re

#: Sentences made of the table; the bound of the training sample.
SENTENCES = 5_000

# Common given names.
GIVEN = """
aaron abigail agnes alan albert alejandro amelia amir andrea angela anton aurora beatrice benjamin bianca boris brenda bruce camila
carl caroline cecilia chloe colin cynthia danielle deborah dennis diana dominic donna eduardo ellen emily enrique esther eugene
evelyn fabio felicia fernando fiona florence gavin george gerald gloria graham gustav hannah harold hector helen henrik holly
howard ian igor imran irene isaac ivy jack janet jason jerome joan jonas joshua juan judith justin kamal keith kenji kevin klara
laurent leonard linda lorenzo louise magnus manuel marcus marion martin matilda maurice megan mia milan miriam monica nathan naomi
nadine nora norman oliver pamela pascal penelope phoebe pilar rachel ralph ramon raymond rebecca reza roger ruth sabine sally
sandra sergio shirley simon sonia stella stephanie susan sylvia tamara teresa thiago timothy ursula valerie vanessa veronica viktor
walter wendy yvonne zainab
""".split()

TEMPLATES = """
could someone phone {name} back, the line dropped
{name} has a parcel waiting at reception
hello {name}, thanks for your patience
we owe {name} a refund for the {word}
my colleague {name} will take over from monday
according to {name} nothing was signed
tell {name} that the {word} arrived
is {name} on holiday or just out today
i met {name} and {name} near {place}
{name} and {name} share a flat at {address}
is {name} still registered at {address}?
{name} asked twice. then {name} gave up
who let {name} into {place} without a badge
the nurse spoke to {name}; the chart lists {id}
{name}, {name} and {name} were late for the {word}
Minutes taken by {name}. Apologies from {name}.
Present: {name}, {name}, {name}. Absent: {name}.
Approved by {name} for the whole board.
Author {name}; reviewer {name}; editor {name}.
Tenant {name} reports a leak at {address}.
Witness {name} identified the caller as {name}.
Applicant: {name}. Document: {id}. Residence: {address}.
Guest {name} checked out; forward letters to {address}.
The lawyer of {name} wrote from {email}.
Please introduce {name} to {name} before lunch.
Remind {name} ({phone}) about the appointment.
Emergency contact: {name}, reachable under {phone}.
Best wishes, {name}
From: {name} <{email}>
To: {email}, {email}
Reply-To: {email}
Attn. {name}, {address}
c/o {name}, {address}
Kind regards from {place}, {name}
Two witnesses, {name} and {name}, describe {place} differently.
Passenger {name} carries {id}.
Payment received from {name}, reference {num}.
Escalate the complaint by {name} to {name}.
Interview with {name}: the {word} was never shown.
Nominate {name} for the {word}. {name} declined.
Yesterday {name} resigned. Her successor is {name}.
did {name} reply? otherwise ask {name}
call {phone} and ask for {name}
our hotline {phone} is down, use {phone}
my number changed to {phone}
fax {phone}, mobile {phone}
ring me on {phone} after six
leave a voicemail at {phone}
the flyer prints {phone} instead of {phone}
SMS to {phone} failed with code {num}
Dial {phone} for {place}.
Reachable day and night: {phone}.
write to {email} and copy {email}
{email} is unsubscribed now
drop {email} from the mailing list
bounce message from {email}
i use {email} at work and {email} at home
Contact {email} or {phone}.
Subscribe {email} to the {word}.
The account {email} was locked after {num} attempts.
Login {email} belongs to {name}.
parking permit for {address}
we moved from {address} to {address}
deliver it to {address} please
pick up at {address}, return to {address}
The meter at {address} shows {num}.
Inspect {address} and note the {word}.
Our branch in {place} is at {address}.
Courier stops: {address}; {address}; {address}.
Is {address} in the same district as {address}?
my papers: {id}
no longer valid: {id}, please renew
{id} was typed wrongly, correct is {id}
Both {id} and {id} belong to one person.
Copy {id} into field {num}.
The clinic needs {id} and {phone}.
Border control recorded {id} for {name}.
does {id} look valid to you
Enter {id} before you continue.
Missing in row {num}: {id}.
Record {num}: {name} / {id} / {phone} / {email} / {address}
{{"customer": "{name}", "tel": "{phone}", "contact": "{email}"}}
{{"id_doc": "{id}", "addr": "{address}", "lang": "en"}}
<person><full>{name}</full><tel>{phone}</tel></person>
name,phone,mail\n{name},{phone},{email}
customer: {name}\naddress: {address}\ntel: {phone}
mysql -e "select id from members where member = '{name}'"
mysql crm -e "delete from leads where email = '{email}' or tel = '{phone}'"
echo '{name}' >> guests.txt
echo "{email}" | xargs -n1 ./unsubscribe
sendmail {email} < letter-{num}.txt
ldapsearch -x "(mail={email})" cn
ldapsearch -x "(cn={name})" telephoneNumber
grep -rn "{id}" archive/{lower}/
grep -c '{name}' visitors/*.tsv
sed -e 's/{name}/redacted/' log/{lower}.txt
perl -ne 'print if /{phone}/' calls-{num}.log
python -c "print('{name}'.title())"
./print_label.sh "{name}" "{address}"
./geocode --addr "{address}" --country {num}
node send.js --recipient {email} --cc {email}
curl -F who="{name}" -F tel="{phone}" http://{host}/forms
mongosh --eval 'db.people.find({{doc: "{id}"}})'
git commit -m "credit {name} for the {word}"
git shortlog --author="{name}" --since={num}
svn blame {lower}.c # ask {name}
export OWNER="{name}" ADMIN={email}
printf "%s;%s" "{name}" "{phone}" > card
cat > note <<Z\nDear {name},\nwe visit {address}.\nZ
if grep -q "{id}" seen; then echo "{name}"; fi
awk '/{name}/ {{n++}} END {{print n}}' desk.log
UPDATE people SET phone='{phone}' WHERE name='{name}';
INSERT INTO homes VALUES ({num}, '{address}');
terraform apply -var region={lower} -auto-approve
kubectl -n {lower} rollout restart deploy/api-{num}
kubectl get pods | grep {hash}
make -j{num} release VERSION=4.{num}.2
cargo build --release --features {lower}
go test ./{lower}/... -run Test{num}
rsync -a build/ web@{host}:/srv/{lower}
scp root@{host}:/var/log/{lower}.log .
ffmpeg -i {lower}.mov -ss 00:12:{num} out.mp4
docker pull ghcr.{lower}.test/base@sha256:{hash}
docker exec -it db_{num} psql
npm install @{lower}/core@{num}.4.1
yarn add left@2.0.{num}
ssh -p 2222 ops@host-{num} 'df -h'
git fetch git@code.{lower}.test:infra/{lower}.git
git cherry-pick {hash}
ping -c 3 {host}
dig +short {lower}.example.net
tail -f /var/log/{lower}/{num}.log
chmod 644 conf/{lower}.ini
du -sh cache/* | sort -h | tail -{num}
wget https://mirror.{lower}.test/v3.{num}/pkg.tar.gz
jq length {lower}.json
date -d @17{num}
The {place} team shipped version 12.{num}.3 on 2023-11-05.
{place} and {place} signed the {word} in {num} copies.
Between 09:15 and 10:45 the {word} of {place} was empty.
Night Shift found the {word} in Bay {num}.
Blue Harbor beat Green Valley by {num} points.
The Data Steward asked {place} for the {word}.
Quarterly Review starts in Hall B with {num} seats.
Project Lantern replaces Project {place} next spring.
Build Farm reports {num} failures since commit {hash}.
Every Monday {place} closes early.
In {place}, the Water Board and the School Council share one {word}.
Nothing from {place} today. Check the {word} tomorrow.
A {word} without an owner is worthless, says the Style Guide.
When the Review Board meets, {place} sends {num} pages.
Case 2031-{num}-77 moved from {place} to {place}.
Invoice 88-{num}-0042 is paid. Invoice 88-{num}-0043 is not.
Tracking code 1Z{hash} left {place}.
Serial 4402 {num} 118 and serial 4402 {num} 119 differ.
Coordinates 51.{num}, 7.{num} lie outside {place}.
Error 0x{hash} at line {num}, see ticket NET-{num}.
The ratio fell from 0.{num} to 0.{num} in {place}.
Rows 100 to {num} of the {word} are blank.
Chapter {num} explains why the {word} matters.
is {place} the same as {place}? the map says no
can we skip the {word} for {place} this week
the {word} keeps failing, restarted it {num} times
nobody opened the {word} since the Spring Fair
why is port {num} closed on {host}
what does flag {num} of the {word} do
thanks, the {word} works again
please shorten the {word} to {num} words
compare {place} with {place} by cost
Sort the {word} by date and drop column {num}.
Translate the {word} into French, keep the numbers.
Open Question {num}: who owns the {word} of {place}?
First Draft and Final Draft of the {word} differ in {num} places.
Before Easter {place} had {num} members, now {num}.
Aisle B, row {num}: count the {noun} boxes.
see section D, page {num}, on {noun}
Block F, because of {noun}, stays shut.
Level A, {noun} and level B, {noun} were mixed up.
Gate E, {word}, {noun}.
keep {noun}, drop {noun}
Agenda for {place}: discuss {noun}, postpone {noun}.
Topics: {noun}, {noun} and {noun}.
Without {noun} there is no {noun}, and without {noun} no {word}.
{team} met {team} to talk about {noun}.
Ask {team} for more {noun}.
{team} and {team} rewrote the {word}. Afterwards, {team} left.
Please repeat Phase Two for {team} and {team}
The {place} Committee and the {team} disagree on {noun}.
Later {team} opened the {word} of {place}.
After {place}, the {word} went to {team}, yet {noun} was low.
Between {place} and {place} there is no {noun}.
Near {place}, {noun} grew by {num}%; in {place}, it fell.
To {place}, the {word} means {noun}. To {place}, nothing.
At {place}, yet again, the {adj} {word} broke.
From {place} to {place}, then back to {place}.
For {place}, count the {adj} {word} entries and stop.
Visit {place}, {place} and {place}, in that order.
{place}, our {adj} neighbour, has no {word}.
{place} opened {num} {adj} files, but {place} closed none.
Why did {place} lose its {word}? Because {noun} was {adj}.
{adj} {noun} beats {adj} {noun}
a {adj} {word} is better than a {adj} one
They lost the {word} only once, and {noun} was never {adj}.
The {adj} clerk compared {noun} with {noun}, as always.
our {adj} cook, the {adj} driver and the {adj} guard left early
The {word}, {adj} and {adj}, hides {num} of {num} pages.
Nobody in {place} trusts {noun}. Everybody in {place} wants {noun}.
grep -n {lower} {lower}.md | sort | uniq -c
git checkout -b {lower}-{noun} && git push
pytest -k {noun} --maxfail={num}
ctest -R "{noun} {word}" --repeat {num}
mocha -g "{word}" test/{lower}.js
./run.sh --mode {adj} --{noun} {num}
echo {noun} > {lower}.txt; cat {lower}.txt
python {lower}.py --check {noun} --date 20240102
note from {name}: {noun} is {adj}
ask {name} if {noun} is {adj}
{name} says {noun} comes first, {place} second
we pay {name} for {noun} and {name} for {noun}
give {name} the {word}, take it from {name}
phone {name} once {place} opens
show {name} around {place}
Search {name} in our {place} files and tell {email}.
Find {name} among the {place} guests.
Look for {name} inside the {place} {word} and post it to {email}.
pick {name} from the {place} list
Go through {place} with {name} and {name}.
put {name} on the list and strike {name} off
the record names {name}, holder of {id}
the file still lists {name} and has {id}
does {phone} still reach {name}?
new entry {name}, {phone}, {place}
{name} rang from {phone} about {noun}
{name} wrote again from {email} about the {word}
for {name} / {phone} / {address}
bill {name} / {address} / {email}
tool --user "{name}" --note "{noun}"
user.full = "{name}"  # {noun}
set owner "{name}"; set mail {email}
cat > tag.txt <<Q\n{name}\n{address}\n{phone}\nQ
""".strip().split("\n")

_START = "an be cor dal fer gor hel jor kar lin mor nor pel ros sal tor val wen zel bra cla dre fra gri kre ols sten tri vol".split()
_MID = "a e i o u ar en il or an ol us im ed av is un el".split()
_SURNAME = "berg man mann sson sen son ova enko ski ley by rez eira etti ini ström lund gaard ton ford stein idis poulos yan escu well more wood shaw kins beck hart auer elli ard ault dahl rud vik nen ovic wicz ic as is eau ier o a i ana enas ung ang uda".split()
_PLACE = "haven wick bury ford dale low mere gate sund ridge mouth ston field port brook cliff wood stead combe thwaite rock bay mill".split()
_TOWN = "ville mouth stead ham heim vik burg by minster thorpe ton port bridge furt hausen".split()
_STAGE, _COUNT = "Step Phase Stage Part Round Level Track Unit".split(), "One Two Three Four Five Six Seven Eight Nine Ten".split()
_NOUNS = "patience courage honesty speed comfort safety silence growth balance beauty freedom luck warmth traffic music health taste order chance profit demand supply progress doubt energy weather pressure quality volume distance".split()
_ADJECTIVES = "early wooden careful noisy empty narrow golden honest rusty simple modern sleepy bitter clever gentle hollow idle jolly tidy vague young round loose plain steep".split()
_TEAM = "Golden Silver North South West Upper Lower Grand Central Public Royal Spring Winter Summer Autumn Iron Stone River Ocean Forest Mountain Market Harvest Morning Evening Crystal".split()
_BODY = "Office Desk Group Council Gallery Library Museum Station Garden Bridge Theatre Hall Archive Studio Clinic Agency League Union Society Bank Press Tower Wing Club Fund Court Festival Notes Plan Report Review".split()
_WORDS = "contract|monthly newsletter|price list|floor plan|survey|backup job|training deck|meeting room|coffee machine|release checklist|draft|spreadsheet|visitor badge|shipping label|test run|cookbook|weather chart|bus timetable|garden hose|archive box|style sheet|login page|login form|menu|budget line|choir song".split("|")


class Filler:
    """Random values of the slots."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def stem(self) -> str:
        r = self.r
        return r.choice(_START) + "".join(r.choice(_MID) + r.choice(["", r.choice("lnrsmdv")]) for _ in range(r.choice([0, 1, 1])))

    def first(self) -> str:
        """A common given name, or one nobody has heard of."""
        return self.r.choice(GIVEN) if self.r.random() < 0.45 else self.stem() + self.r.choice(["", "a", "o", "e", "in", "us"])

    def surname(self) -> str:
        one = (self.stem() + self.r.choice(_SURNAME)).capitalize()
        if self.r.random() < 0.12:
            one += "-" + (self.stem() + self.r.choice(_SURNAME)).capitalize()
        if self.r.random() < 0.14:
            one = self.r.choice(["von ", "de ", "van ", "van der ", "bin ", "da ", "di ", "el ", "al-", "O'"]) + one
        return one

    def name(self) -> str:
        r = self.r
        given, family = self.first().capitalize(), self.surname()
        k = r.random()
        out = (
            f"{given} {family}" if k < 0.43 else f"{family}, {given}" if k < 0.58 else f"{given[0]}. {family}" if k < 0.7
            else f"{r.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Dr.', 'Prof.', 'Mr.'])} {family}" if k < 0.84
            else f"{given} {r.choice('ABCDEFGHJKLMNPRSTW')}. {family}" if k < 0.93 else f"{r.choice(['Dr.', 'Prof.', 'Ms'])} {given} {family}"
        )
        k = r.random()
        return out.upper() if k < 0.12 else out.lower() if k < 0.24 else out

    def email(self) -> str:
        r = self.r
        given, family = self.first(), self.surname().lower().replace(" ", "").replace("'", "")
        ascii_ = lambda s: s.encode("ascii", "ignore").decode() or "x"
        given, family = ascii_(given), ascii_(family)
        local = r.choice([f"{given}.{family}", f"{given[0]}{family}", f"{family}_{given}", f"{given}{r.randrange(10, 99)}", f"{family}-{given[0]}"])
        local += r.choice(["", "", "", "+alerts", "+roster", "+x"])
        host = r.choice(["", "mail.", "desk."]) + self.place().lower() + r.choice(["", "", "-office"]) + "." + r.choice(["example.org", "example.com", "example.net", "invalid", "test", "example"])
        at = r.choice(["@"] * 8 + ["%40", " @ ", "(at)", " [at] ", " at "])
        out = local + at + host
        if at in ("(at)", " at "):
            out = local + at + host.replace(".", "[dot]" if at == "(at)" else " dot ")
        if r.random() < 0.08:
            out = out.upper()
        return ("mailto:" if r.random() < 0.05 and at == "@" else "") + out

    def phone(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        area, line = r.choice(["212", "312", "415", "503", "617", "775", "202", "646"]), "01" + d(2)
        us = r.choice([f"{area}-555-{line}", f"({area}) 555-{line}", f"{area} 555 {line}", f"{area}.555.{line}", f"+1 {area} 555 {line}", f"1-{area}-555-{line}", f"+1{area}555{line}"])
        out = r.choice([us, us, us, f"020 7946 0{d(3)}", f"07700 900{d(3)}", f"+44 7700 900{d(3)}", f"+44 20 7946 0{d(3)}", f"+44 (0)20 7946 0{d(3)}", f"+44 (0)7700 900{d(3)}", f"+49 (0)30 23125 {d(3)}", f"030 23125 {d(3)}", f"+49 30 23125-{d(3)}", f"01 99 00 {d(2)} {d(2)}", f"+33 1 99 00 {d(2)} {d(2)}", f"0491 570 {d(3)}", f"+61 491 570 {d(3)}", f"91 555 {d(2)} {d(2)}", f"+34 91 555 {d(4)}", f"(0{d(2)}) {d(4)} {d(4)}"])
        return out + (f" ext. {d(2)}" if r.random() < 0.1 else "")

    def id(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        sep = r.choice(["-", " ", "-", ""])
        ssn = f"{r.choice(['000', '666', '9' + d(2)])}{sep}{d(2)}{sep}{d(4)}"
        ssn = ssn if r.random() < 0.7 else f"{r.choice(['000', '666', '9' + d(2)])}{d(6)}"
        dash = r.choice(["-", "-", " "])
        up = r.choice("ABCDEFGHJKLMXYZ")
        return r.choice([
            f"{r.choice(['ssn:', 'SSN', 'social', 'soc. sec. no.', 'social security number'])} {ssn}", f"{r.choice(['ssn:', 'social', 'soc. sec. no.', 'social security number'])} {ssn}",
            f"{r.choice(['passport', 'passport no.', 'Passport', 'travel document', 'travel document no.', 'visa no.', 'residence permit'])} {up}{r.choice(['', ' '])}{d(7)}", f"{r.choice(['DNI', 'id card', 'national id', 'ID card no.', 'NIE'])} {d(8)}{r.choice(['', '', '-'])}{up}",
            f"{r.choice(['NINO', 'national insurance no.', 'national insurance number', 'NI number'])} QQ {d(6)} {r.choice('ABCD')}", f"NINO QQ{d(6)}{r.choice('ABCD')}", f"NINO QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}",
            f"{r.choice(["driver’s licence", "driver's licence", 'licence no.', 'driving licence', 'driver license'])} {up}{d(3)}{dash}{d(3)}{dash}{d(2)}", f"{d(3)}-{d(2)}-{d(4)}",
        ])

    def place(self) -> str:
        return (self.stem() + self.r.choice(_PLACE)).capitalize()

    def address(self) -> str:
        r = self.r
        town, street, n = (self.stem() + r.choice(_TOWN)).capitalize(), self.place(), r.randrange(1, 2500)
        code = "00" + "".join(r.choice("0123456789") for _ in range(3))
        kind = r.choice(["St.", "St", "Ave.", "Avenue", "Road", "Rd", "Lane", "lane", "street", "Drive", "Blvd", "Court", "Pkwy", "Way", "Place", "Ter", "Cir", "Sq", "Row", "Hwy", "Trail", "Loop"])
        return r.choice([
            f"{n} {street} {kind}, {town}", f"{n} {street} {kind} in {town}", f"{n} {r.choice(['N', 'S', 'E', 'W'])} {street} {kind}, {r.choice(['Unit', 'Apt', '#', 'Suite'])} {r.randrange(1, 40)}, {town} {code}",
            f"{n} {street} {kind}, {town} {code}", f"Flat {r.randrange(1, 40)}, {r.randrange(1, 200)} {street} {r.choice(['Close', 'Crescent', 'Road', 'Terrace'])}, {town}, ZX{r.randrange(1, 10)} {r.randrange(1, 10)}QX",
            f"{r.randrange(1, 200)} rue {street}, {code} {town}", f"Calle {street} {r.randrange(1, 150)}, {r.randrange(1, 9)}º, {code} {town}",
            f"{street}{r.choice(['gasse', 'weg', 'str.', 'straße', 'platz'])} {r.randrange(1, 180)}, {code} {town}",
        ])

    def slot(self, kind: str) -> str:
        r = self.r
        if kind in ("name", "email", "phone", "id", "address", "place"):
            return getattr(self, kind)()
        return {
            "word": lambda: r.choice(_WORDS), "noun": lambda: r.choice(_NOUNS), "adj": lambda: r.choice(_ADJECTIVES),
            "team": lambda: f"{r.choice(_TEAM)} {r.choice(_BODY)}" if r.random() < 0.8 else f"{r.choice(_STAGE)} {r.choice(_COUNT)}", "num": lambda: str(r.randrange(1, 10_000)), "host": lambda: f"192.0.2.{r.randrange(1, 99)}",
            "hash": lambda: "%012x" % r.randrange(16**12), "lower": lambda: self.place().lower(), "repo": lambda: self.place(),
        }[kind]()


def sentences(n: int = SENTENCES, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts: (text, [(from, to, kind)])."""
    fill = Filler(seed)
    out = []
    for k in range(n):
        text, items = "", []
        parts = [TEMPLATES[(k * 7 + k // len(TEMPLATES)) % len(TEMPLATES)]]
        while fill.r.random() < 0.3 and len(parts) < 4:
            parts.append(fill.r.choice(TEMPLATES))
        joined = fill.r.choice([" ", "\n", "\n- "]).join(parts).replace("\\n", "\n")
        for piece in re.split(r"(\{\w+\})", joined.replace("{{", "\x01").replace("}}", "\x02")):
            if re.fullmatch(r"\{\w+\}", piece):
                value = fill.slot(piece[1:-1])
                if piece[1:-1] in ("name", "email", "phone", "id", "address"):
                    items.append((len(text), len(text) + len(value), piece[1:-1]))
                text += value
            else:
                text += piece.replace("\x01", "{").replace("\x02", "}")
        out.append((text, items))
    return out
