"""The labelled table that the personal-information model is trained from.

A line is a sentence with slots; a slot's value is labelled with the slot's type, all else is
outside.  Lines, lists and forms are written from general knowledge and none is taken from the tables the
model is used on.  Values are drawn with a fixed seed; invented family names are built from syllables, so that a
name is learnt by its place and form.  Lines without a slot teach what only looks like personal information.
"""

from __future__ import annotations

import random

TYPES = ("email", "phone", "id_number", "address", "name")

# --- fixed values: the table --------------------------------------------------
LINES = (
    "signed: {name}, md.", "dictated by {name}.", "electronically signed by {name}, md on {date}.", "read by {name}.", "prepared by {name} and checked by {name}.", "reviewed with {name} on {date}.",
    "reported by {name}, consultant.", "transcribed by {name} at {time}.", "verified: {name}.", "the trainee, {name}, performed the puncture.", "under supervision of prof. {name}.", "dr. {name} took the consent.",
    "dr {name} was told about this at {time}.", "dr. {name} asked for the {study}.", "sent by dr {name}, {address}.", "dr. {name}, who knows the patient, was called.", "professor {name} will see the patient.", "seen together with dr. {name} and dr. {name}.",
    "results called to {name} at {time}.", "these results were told to dr. {name} over the phone ({phone}) at {time}.", "told to nurse {name} on the ward.", "sister {name} took the message.", "paged {name} at {time}.", "called by {name} at {time}.",
    "the radiographer {name} took the images.", "images taken by {name}.", "mr. {name} came with his wife.", "mr {name} lay still throughout.", "mrs. {name} reports {symptom}.", "mrs {name} was seen because of {symptom}.", "ms. {name} has had {symptom} since {date}.",
    "miss {name} asked for a female examiner.", "mr. {name}, {n}, has {symptom}.", "mrs. {name}, {id_number}, came for {study}.", "ms {name}, living at {address}, has {symptom}.", "mr. {name} ({id_number}) has been sent for {study}.", "patient: {name}, born {date}.",
    "name: {name}.", "name of patient: {name}; {id_number}.", "patient {name} was brought by ambulance.", "this is {name}, a {n} year old with {symptom}.", "we saw {name} today.", "{name} consents to the procedure.", "{name} came in with {symptom}.",
    "{name} has no known allergies.", "{name}, {n} years, {symptom}.", "{name} will be told by letter.", "{name} was contacted under {phone}.", "{name} on {phone} knows.", "{name} can be reached at {phone} or {email}.", "husband {name} was in the room.",
    "her husband {name} interpreted.", "his wife {name} interpreted for us.", "the son, {name}, gave the history.", "her daughter {name} lives nearby.", "mother {name} stayed with the child.", "father: {name}, {phone}.", "uncle {name} brought the child in.",
    "the carer, {name}, can be phoned on {phone}.", "sister-in-law {name} holds the power of attorney.", "guardian {name} signed the form.", "friend {name} drove.", "neighbour {name} found the patient on the floor.", "interpreter {name} was present.", "consent given by {name}.",
    "{name} (wife) and {name} (son) visited.", "{name}, the patient's partner, was informed.", "relative to contact: {name}, {phone}.", "in an emergency call {name} on {phone}.", "cc {name}; {email}.", "cc {name}, {name}.", "cc: dr. {name}, {address}.", "copies: {email}, {email}.",
    "contact: {email}.", "please mail results to {email}.", "e-mail {email} for the images.", "write to {email} for a disc.", "the patient's e-mail is {email}.", "email address {email}, phone {phone}.", "reply to {email} or fax {phone}.", "a link was mailed to {email} on {date}.",
    "upload link: {email}.", "forwarded to {email} by {name}.", "fax {phone}.", "fax no. {phone}.", "mobile {phone}.", "tel. {phone}.", "tel: {phone}, fax: {phone}.", "phone: {phone}.", "telephone {phone}.", "cell {phone}.", "home phone {phone}, work {phone}.", "pager {phone}.",
    "ring {phone} to book the {study}.", "to cancel, dial {phone}.", "the surgery's number is {phone}.", "phoned from {phone} at {time}.", "text messages to {phone} please.", "can be called on {phone} after {time}.", "voicemail left at {phone}.", "reports by fax to {phone}.",
    "mobile number {phone}.", "phone number {phone}.", "contact number: {phone}.", "her number is {phone}.", "{phone} is his mobile number.", "{phone} (mobile), {phone} (office).", "the patient left the number {phone}.", "number of the daughter {phone}.", "best number {phone} in the evening.",
    "the office number {phone} was engaged at {time}.", "direct line {phone}.", "hotline {phone}.", "please phone {phone} or write to {email}.", "{phone}, ask for {name}.", "his brother's phone {phone} is off.", "switchboard {phone}, extension {n3}.", "number on file {phone}.", "husband's mobile {phone}.", "wife {name}, {phone}, was told.",
    "booked by {name} from the clinic.", "for the attention of {name}.", "addressed to {name}, {address}.", "handed to {name} in person.", "driven home by {name}.", "picked up by {name} at {time}.", "with {name} at the bedside.", "according to {name} the patient fell.", "on behalf of {name}.", "to {name}: please review.", "copy for {name} and {name}.",
    "the assistant {name} held the probe.", "radiographer {name} repeated two views.", "technician {name} left a note.", "nurse {name} removed the line.", "midwife {name} was there.", "physiotherapist {name} asks for advice.", "registrar {name} agrees with this.", "fellow {name} and attending {name}.", "secretary {name} typed this.", "porter {name} waited.",
    "ms {name} from {address} came alone.", "mr {name}, {address}, was asked to come again.", "mrs {name} (mobile {phone}) will ring us.", "ms. {name} left early.", "mr. {name} feels better.", "mrs. {name} sleeps well.", "miss {name} is pregnant.", "mr {name} was told to fast.", "grandmother {name} raised the child.", "aunt {name} came along.",
    "spouse: {name}.", "next contact {name}, {email}.", "the wife, {name}, agrees.", "the family ({name}, {phone}) was told.", "my colleague {name} will operate.", "our guest {name} watched.", "a letter to {name} was dictated.", "{name} phoned at {time}.", "{name} wrote from {email}.", "{name} lives at {address}.", "{name} moved house.", "{name} gave blood.",
    "the disc was posted to {address}.", "taxi to {address}.", "sends mail to {address}, attention of {name}.", "the house at {address} is empty.", "at {address} since {date}.", "from {address}.", "of {address}.", "second home: {address}.", "the patient of {address} is known.", "visit at {address} on {date}.", "the chart of {id_number} was opened.", "with {id_number} as proof.", "wrong chart: {id_number}.",
    "before the {study} {id_number} was checked.", "{id_number} belongs to the sister.", "the old {id_number} is void.", "see {id_number}.", "quote {id_number} when you write to {email}.",
    "lives at {address}.", "moved to {address} in {date}.", "resides at {address}.", "address: {address}.", "present address {address}.", "collected from {address} at {time}.", "ambulance to {address}.", "discharged to {address}, where {name} will care for the patient.",
    "bills to {name}, {address}.", "the patient fell in front of {address}.", "post to {address}.", "works at {address}.", "nursing home, {address}.", "found at home, {address}, by {name}.", "{id_number}.", "{id_number}, {name}.", "patient identified by {id_number}.", "identity checked: {id_number}.",
    "filed under {id_number}.", "the label reads {id_number}.", "insured, {id_number}.", "{id_number} and {id_number} belong to one person.", "travels on {id_number}.", "registered with {id_number}, {address}.", "two charts exist, {id_number} and {id_number}.", "wristband shows {id_number}.",
)
OTHERS = (
    "accession number {num}.", "accession {num} and {num} were read together.", "order number {num}.", "order {num} was placed twice.", "lot number {num} of the contrast agent.", "batch {num}, expiry {date}.", "serial number {num}.", "device {num}-{n3} was calibrated.", "pacemaker model {num}.",
    "invoice {num} was sent.", "billing code {n3}.{n1}.", "claim {num} is open.", "charge code {num}.", "procedure code {num}.", "study number {num}, series {n}.", "protocol {n3}-{n}.", "room {n}, bed {n1}.", "bay {n}b on level {n1}.", "slices {n3}-{n3}.", "image {n3} of series {n}.",
    "ticket {num} was closed.", "part no. {n}-{n3}-{n3}.", "catalogue number {n}-{n3}-{n3} was ordered.", "frames {n3}-{n3}-{n3}.", "slides {n}-{n3}-{n} and {n3}.", "since {date}, {n}.{n1} mm.", "from {date} to {date}.", "{n}.{n1} against {n}.{n1} on {date}.", "catalogue no. {num}.", "scanner id {num}.", "cassette {num}.", "bar code {num} could not be read.", "dose {n3}.{n1} mgy cm.", "activity {n3} mbq at {time}.", "flow of {n3} ml per minute.", "{n3} ml of contrast were given at {time}.", "gfr {n}, creatinine {n1}.{n1}.",
    "{eponym} is suspected.", "history of {eponym}.", "known {eponym} and {symptom}.", "no sign of {eponym}.", "{eponym} after treatment.", "typical for {eponym}.", "{eponym} in the {part}.", "{eponym} was ruled out on {date}.", "{eponym} measures {n} mm.", "graded by {eponym}.", "small {eponym}, unchanged.", "{eponym}; {finding} in the {part}.",
    "dr. ___ was told about it.", "mrs. ___ reports {symptom}.", "referred by dr ___.", "dr. [redacted] took the call.", "mr. had no complaints.", "told to dr. over the phone.", "the doctor on call was told at {time}.", "mrs. is well.", "seen by dr. ___ and nurse ___.", "name withheld.", "e-mail not given.", "no phone.", "address unknown.", "dr. at .",
    "comparison: {date}.", "comparison with {date} shows no change.", "no change since {date}.", "{finding} of {n} mm, formerly {n} mm.", "a {n} x {n} mm {finding} in the {part}.", "{part}: {finding}.", "{finding} next to the {part}, {n}.{n1} cm.", "indication: {symptom}.", "indication: {symptom} and {symptom}, {n} years.", "clinical question: {finding}?",
    "technique: {study} of the {part}.", "the {study} shows {finding}.", "the {part} is normal.", "the {part} and the {part} are normal.", "no {finding}.", "no {finding} or {finding}.", "impression: {finding} of the {part}.", "1. {finding}. 2. {finding}.", "recommend {study} in {n} months.", "follow up by {study} is advised.",
    "{symptom} is the likely cause.", "consistent with {symptom}.", "{finding}, {mod}.", "the {finding} is {mod}.", "new {finding} at the {part}.", "old {finding}, {mod}, and {finding}.", "probable {symptom} with {finding} at the {part}.", "stable {finding} near the {part}.", "improved {finding} of the {part} since {date}.",
    "limited by motion.", "the patient moved during the scan.", "patient could not hold still.", "the patient declined contrast.", "she lives alone and walks with a stick.", "he works at a mill and drives a truck.", "wisdom tooth at the {part}.", "ward round at {time}.", "ct chest abdomen pelvis.", "chest x ray, two views.", "findings discussed in the meeting.",
    "sagittal t1 and axial t2 images.", "green street view of the film is poor.", "main pulmonary artery {n} mm.", "court type wound.", "right main bronchus, left main stem.", "high grade stenosis.", "park position of the arm.", "north pole of the kidney.", "the square brackets mark doubt.", "way of access: femoral.", "drive line of the pump.", "close contact of both.",
    "i cannot give an opinion on this.", "this cannot be answered here.", "final.", "end of report.", "{n} years, male.", "aged {n} months.", "you may ask for a second opinion.", "nothing else can be said about it.", "please speak to someone at the desk.", "our rules do not permit more.", "a specialist should look at this again.", "this text was made by a machine.", "{n}.", "see text.", "compte rendu.", "befund.", "informe.", "as above.", "thank you for the referral.", "yours sincerely.",
)
#: lines in other languages, whose words a corpus may not know
FOREIGN_OTHERS = (
    "befund: {n} mm grosse zyste, sonst unauffällig.", "der patient ist {n} jahre alt und hat schmerzen.", "keine fraktur, kein erguss.", "vergleich mit der voraufnahme: unverändert.", "die leber ist normal gross.", "zustand nach operation vor {n1} jahren.", "verdacht auf pneumonie rechts.", "im ct zeigt sich eine {n},{n1} cm grosse raumforderung.",
    "paciente de {n} años, dolor abdominal.", "no hay fracturas ni derrame.", "hígado de tamaño normal.", "se observa un nódulo de {n} mm.", "comparado con el estudio previo, sin cambios.", "lesión de {n},{n1} cm en el riñón izquierdo.", "probable neumonía derecha.", "control en {n1} meses.",
    "patient de {n} ans, douleurs abdominales.", "pas de fracture ni d'épanchement.", "foie de taille normale.", "nodule de {n} mm, stable.", "en comparaison avec l'examen précédent, pas de changement.", "lésion de {n},{n1} cm du rein gauche.", "pneumopathie droite probable.", "contrôle dans {n1} mois.",
    "alter: {n} jahre.", "mann, {n} jahre, raucher.", "frau von {n} jahren.", "{n} jahre, seit {n1} wochen husten.", "kind, {n} monate.", "edad: {n} años.", "hombre de {n} años.", "mujer, {n} años.", "homme, {n} ans.", "femme de {n} ans.", "âge {n} ans.",
    "es besteht kein anhalt für eine thrombose.", "regelrechte darstellung der nieren und der milz.", "empfehlung: verlaufskontrolle in {n1} wochen.", "rechts basal kleine verschattung, am ehesten entzündlich.", "degenerative veränderungen der wirbelsäule.",
    "no se identifican lesiones óseas agresivas.", "vesícula y vías biliares sin alteraciones.", "derrame pleural bilateral de pequeña cuantía.", "se recomienda ecografía de rodilla izquierda.", "cambios degenerativos en columna lumbar.",
    "absence d'anomalie de la vésicule biliaire.", "épanchement pleural bilatéral de faible abondance.", "il est conseillé une échographie du genou gauche.", "lésions dégénératives du rachis lombaire.", "pas de thrombose veineuse profonde visible.",
)
EPONYMS = ("alzheimer disease|parkinson disease|crohn disease|graves disease|paget disease|hodgkin lymphoma|non-hodgkin lymphoma|ewing sarcoma|wilms tumor|kaposi sarcoma|baker cyst|hill-sachs lesion|bankart lesion|colles fracture|smith fracture|"
           "bennett fracture|jones fracture|murphy sign|kerley b lines|virchow node|meckel diverticulum|zenker diverticulum|morgagni hernia|bochdalek hernia|schatzki ring|charcot joint|perthes disease|osgood-schlatter disease|scheuermann disease|"
           "schmorl node|tarlov cyst|rathke cleft cyst|arnold-chiari malformation|dandy-walker malformation|budd-chiari syndrome|ehlers-danlos syndrome|marfan syndrome|down syndrome|turner syndrome|cushing syndrome|horner syndrome|sjogren syndrome|"
           "hashimoto thyroiditis|kienbock disease|haglund deformity|morton neuroma|merkel cell carcinoma|warthin tumor|wegener granulomatosis|takayasu arteritis|kawasaki disease|raynaud phenomenon|barrett esophagus|mallory-weiss tear|gleason score|"
           "bosniak class|child-pugh score|garden type two|weber b fracture|lisfranc injury|segond fracture|chance fracture|le fort fracture|monteggia fracture|pancoast tumor|krukenberg tumor|mirizzi syndrome|caroli disease|whipple procedure|billroth resection")
GIVEN = ("maria anna jose mohammed wei john david michael james robert william mary patricia linda barbara elizabeth jennifer susan sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda dorothy melissa deborah "
         "thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel "
         "oliver harry jack charlie amelia olivia isla ava mia sophie grace lily freya alfie archie oscar leo hans klaus jürgen wolfgang günter ursula ingrid monika sabine anke björn søren åse pierre jean michel françois rené hélène chloé élodie "
         "carlos luis javier carmen lucía josé sofía giulia marco luca chiara jan piotr agnieszka łukasz paweł šime ivan olga dmitri natalia ahmed fatima omar aisha yusuf priya ravi anita sanjay yuki hiroshi kenji mei ling jun min-ji thabo chidi ngozi amara kwame иван анна").split()
FAMILY = ("jones brown davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen king wright scott hill green adams nelson baker hall rivera campbell mitchell carter roberts gonzalez rodriguez "
          "hernandez lopez perez sanchez ramirez torres flores diaz cruz morales reyes gutierrez ortiz müller schneider fischer meyer schulz hoffmann schäfer koch richter klein wolf schröder neumann braun zimmermann krüger lefèvre bernard petit durand leroy "
          "simon laurent michel garnier faure ferrari esposito bianchi romano colombo ricci wójcik kamiński zieliński wałęsa čović horvat novák dvořák svoboda popescu ionescu smirnov kuznetsov popov sokolov петров yılmaz kaya demir hussein ibrahim hassan ali "
          "ahmed sharma singh gupta kumar das reddy wang li zhang liu chen yang huang kim park choi sato suzuki takahashi watanabe yamamoto mbeki adeyemi mensah o'connor o'brien mcdonald macleod fitzgerald").split()
PARTICLES = "van|van der|de|de la|von|al|el|di|da|dos|ter|le".split("|")
STARTS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl fr gl gr kl kr pl pr sch sh sl sp st str th tr qu y".split() + ["", ""]
VOWELS = "a e i o u a e i o ai au ea ee ei ie oa oo ou y".split()
STOPS = "n r l s t m d k ck ll nd ng nn rd rg rm rn rs rt ss st th x tt ff p b g".split() + ["", "", "", ""]
TAILS = "son sen man ton ley ford well worth wood ski sky ov ova ev escu idis poulos ez es inho etti elli eau ier mann berg stein wala yan enko dottir by ham shaw combe more ard er in ic el".split() + [""] * 12
KINDS = "street road avenue lane terrace close drive court rise way place square st. rd. ave. ln. dr. blvd. boulevard crescent grove gardens hill walk row mews parade highway".split()
STREETS = "main|church|station|high|oak|maple|cedar|pine|elm|park|king|queen|river|bridge|north|south|victoria|albert|green|market|school|garden|lake|spring|washington|lincoln|sunset|meadow|forest|chapel|rose|castle|london|east end|old church|second|5th|21st"
FOREIGN = "hauptstraße|schulstraße|gartenstraße|bahnhofstraße|dorfstraße|bergstraße|am markt|kirchplatz|waldweg|lindenallee|goethestr.|berliner straße|rosenweg"
AFTER = "rue de la paix|rue victor hugo|avenue de la gare|rue du moulin|place de l'église"
BEFORE = "calle mayor|calle del sol|avenida de la constitución|plaza de españa|via roma|via garibaldi|rua augusta"
TOWNS = "springfield|newport|kingston|dover|lincoln|hamburg|köln|london|leeds|boston|austin|denver|lyon|madrid|sevilla|torino|wien|zürich|oslo|dublin|cardiff|perth|salem|georgetown|franklin|clinton|arlington|ashland"
HOSTS = "gmail.com yahoo.com outlook.com hotmail.com icloud.com aol.com gmx.de web.de orange.fr libero.it protonmail.com example.com example.org example.net test.example nhs.uk".split()
TOPS = "com org net edu de fr uk co.uk es it eu info example test invalid health".split()
STUDIES = "mri|ct|ultrasound|radiograph|pet ct|mammogram|fluoroscopy|bone scan|doppler|angiogram|x ray|cystogram|myelogram|ct guided biopsy"
PARTS = ("lung|left lung|right lung|liver|spleen|kidney|left kidney|pancreas|stomach|bowel|colon|rectum|bladder|prostate|uterus|ovary|breast|thyroid|brain|cerebellum|skull|orbit|neck|spine|l5|c6|t12 vertebra|pelvis|hip|knee|ankle|foot|shoulder|elbow|wrist|hand|"
         "heart|left ventricle|aorta|carotid artery|vena cava|portal vein|bile duct|gallbladder|appendix|hilum|pleura|mediastinum|rib|sternum|clavicle|femur|tibia|humerus|radius|scaphoid|sacrum|muscle|tendon|meniscus")
FINDINGS = ("cyst|nodule|mass|fracture|effusion|hematoma|calcification|stenosis|thrombus|edema|hernia|polyp|abscess|tear|lesion|opacity|consolidation|atelectasis|pneumothorax|dilatation|occlusion|aneurysm|stone|obstruction|infarct|bleed|tumor|metastasis|"
            "lymph nodes|degeneration|scoliosis|sclerosis|erosion|thickening|enhancement|fluid collection|foreign body|air fluid level|scar|fibrosis")
SYMPTOMS = ("pain|headache|fever|cough|dyspnea|syncope|vertigo|vomiting|diarrhea|weight loss|fatigue|swelling|numbness|weakness|trauma|a fall|a car accident|hematuria|jaundice|anemia|hypertension|diabetes|pneumonia|sepsis|stroke|cancer|lymphoma|melanoma|gout|"
            "arthritis|asthma|copd|heart failure|renal failure|pregnancy|chemotherapy|surgery|dialysis|transplant|infection")
MODS = "stable|new|larger|smaller|unchanged|likely benign|suspicious|old|of unclear origin|incidental|postoperative|inflammatory|degenerative|probably traumatic"
# -----------------------------------------------------------------------------


class Draw:
    """Slot values from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def of(self, text: str) -> str:
        return self.r.choice(text.split("|"))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def invented(self) -> str:
        """A word of one to three syllables with an ending that family names have, or none."""
        r = self.r
        w = "".join(r.choice(STARTS) + r.choice(VOWELS) + r.choice(STOPS) for _ in range(r.choice((1, 1, 2, 2, 2)))) + r.choice(TAILS)
        return w if len(w) > 3 else w + r.choice("aeo") + r.choice("nrsl")

    def family(self) -> str:
        one = lambda: self.r.choice(FAMILY) if self.r.random() < 0.3 else self.invented()
        x = self.r.random()
        if x < 0.12:
            return f"{one()}-{one()}"
        if x < 0.17:
            return f"{self.r.choice(PARTICLES)} {one()}"
        if x < 0.2:
            return self.r.choice(("o'", "mc", "d'", "mac")) + one()
        return one()

    def name(self) -> str:
        g, f, x = self.r.choice(GIVEN) if self.r.random() < 0.8 else self.invented(), self.family(), self.r.random()
        if x < 0.44:
            return f"{g} {f}"
        if x < 0.62:
            return f"{f}, {g}"
        if x < 0.79:
            return f"{g[0]}. {f}"
        if x < 0.85:
            return f"{g} {self.r.choice('abcdefghjklmnoprstw')}. {f}"
        if x < 0.91:
            return f"{g} {f[0]}."
        if x < 0.95:
            return f"{f}, {g[0]}."
        if x < 0.97:
            return f"{g} {self.r.choice(GIVEN)} {f}"
        return f"{g[0]} {f}" if x < 0.98 else f"{g[0]}.{self.r.choice('abcjklm')}. {f}"

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c = str(r.randint(200, 999)), str(r.randint(200, 999)), d(4)
        return r.choice(
            (f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}-{b}-{c} ext. {d(3)}", f"+1-{a}-{b}-{c} ext {d(2)}", f"{b}-{c}", f"{b} {c}", f"020 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"0{d(4)} {d(6)}",
             f"+44 (0){d(4)} {d(3)} {d(3)}", f"{a} {b} {c}", f"+49 {d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"({a}){b}-{c} x{d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(7)}", f"({a}) {b} {c}")
        )

    def id_number(self) -> str:
        r, d = self.r, self.digits
        kind = r.choice(("mrn", "mrn:", "mrn", "mrn #", "medical record number", "medical record no.", "ssn", "ssn:", "social security number", "social security no.", "patient id", "patient number", "patient no.", "passport", "passport no.", "passport number", "health card", "health insurance number",
                         "hospital no.", "hospital number", "national insurance number", "ni number", "nhs number", "nhs no.", "driver license", "driver's license no.", "driving licence", "national id", "id card", "insurance id", "member id", "policy holder id", "tax id", "chart number", "personal number"))
        form = r.choice((d(8), d(7), d(6), d(9), d(10), f"{d(4)}-{d(3)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)}-{d(3)}-{d(3)}", f"{r.choice('abcdfhklmpqx')}{d(7)}", f"{r.choice('abcdfhklmpqx')}{d(8)}", f"{r.choice('abhmp')}-{d(6)}",
                         f"{r.choice('abcdhp')}{r.choice('abcdht')}{d(7)}", f"{r.choice('abcq')}{r.choice('abcq')} {d(2)} {d(2)} {d(2)} {r.choice('abcd')}", f"{d(2)}-{d(7)}"))
        return f"{kind} {form}"

    def address(self) -> str:
        r, x, n = self.r, self.r.random(), self.r.randint(1, 999)
        if x < 0.2:
            out = f"{self.of(FOREIGN) if r.random() < 0.5 else self.invented() + r.choice(('straße', 'strasse', 'weg', 'gasse', 'str.', 'allee'))} {r.randint(1, 190)}" + r.choice(("", "", "a"))
        elif x < 0.25:
            out = f"{n} {self.of(AFTER)}"
        elif x < 0.3:
            out = f"{self.of(BEFORE)} {n}"
        else:
            street = self.of(STREETS) if r.random() < 0.35 else f"{self.invented()} {self.invented()}" if r.random() < 0.3 else self.invented()
            out = f"{n}{r.choice(('', '', '', 'a', 'b'))} {street} {r.choice(KINDS)}"
            if r.random() < 0.2:
                out = f"{r.choice(('flat', 'unit', 'apartment'))} {r.randint(1, 60)}, {out}"
            elif r.random() < 0.2:
                out += f", {r.choice(('apt', 'apt.', 'suite', 'unit', '#'))} {r.randint(1, 40)}{r.choice(('', 'a', 'b'))}"
        if r.random() < 0.4:
            out += f", {self.of(TOWNS) if r.random() < 0.6 else self.invented()}" + (f" {self.digits(5)}" if r.random() < 0.4 else "")
        return out

    def email(self) -> str:
        r = self.r
        g, f = r.choice(GIVEN), self.family().replace("-", "").replace("'", "").replace(" ", "")
        d = r.choice(HOSTS) if r.random() < 0.35 else f"{r.choice(('', '', self.invented() + '-', self.invented() + '.'))}{self.invented()}.{r.choice(TOPS)}"
        user = r.choice((f"{g}.{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g}{self.digits(4)}", f"{f}{self.digits(2)}", f"{g}+{f}", f"{f}.{g[0]}", f"{g}_{f}", f"{g[0]}.{f}", "office", f"info.{f}"))
        x = r.random()
        if x < 0.66:
            return f"{user}@{d}"
        if x < 0.74:
            return f"{user} @ {d}"
        if x < 0.84:
            return f"{user} {r.choice(('[at]', '(at)', '{at}'))} {d.replace('.', r.choice(('.', ' [dot] ', ' (dot) ', ' dot ')))}"
        return f"{user} at {d.replace('.', ' dot ')}"

    def other(self, slot: str) -> str:
        r = self.r
        return {
            "time": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
            "date": lambda: r.choice((f"20{r.randint(10, 23)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.choice(MONTHS)} {r.randint(2010, 2023)}", f"{r.randint(1, 28)} {r.choice(MONTHS)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{r.randint(10, 23)}", "")),
            "n": lambda: str(r.randint(1, 99)), "n1": lambda: str(r.randint(0, 9)), "n3": lambda: str(r.randint(10, 499)),
            "num": lambda: r.choice(("", "", "", "a", "sn-", "x")) + self.digits(r.randint(5, 9)) + r.choice(("", "", "", f"-{r.randint(1, 99)}")),
            "study": lambda: self.of(STUDIES), "part": lambda: self.of(PARTS), "finding": lambda: self.of(FINDINGS), "symptom": lambda: self.of(SYMPTOMS), "mod": lambda: self.of(MODS), "eponym": lambda: self.of(EPONYMS),
        }[slot]()


MONTHS = "january february march april may june july august september october november december".split()


def fill(line: str, d: Draw) -> list[tuple[str, str | None]]:
    """(text, type or None) pieces of a line with its slots filled."""
    out, rest = [], line
    while "{" in rest:
        head, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        out.append((head, None))
        out.append((getattr(d, slot)(), slot) if slot in TYPES else (d.other(slot), None))
    out.append((rest, None))
    return [p for p in out if p[0]]


def labelled_texts(n: int = 5000, seed: int = 3, lines: tuple[str, ...] = LINES, others: tuple[str, ...] = OTHERS) -> list[list[tuple[str, str | None]]]:
    """n short texts of two or three sentences as pieces (text, type), in the letter cases that occur; outside of values the type is None, or foreign."""
    d = Draw(seed)
    out = []
    for i in range(n):
        other = lambda: d.r.choice(others) if d.r.random() < 0.7 else d.r.choice(FOREIGN_OTHERS)
        own = [other(), lines[i % len(lines)] if d.r.random() < 0.75 else other(), other()][: d.r.choice((2, 3, 3))]
        pieces: list[tuple[str, str | None]] = []
        for line in own:
            if pieces:
                pieces.append((" ", None))
            pieces += [(t, "foreign") if line in FOREIGN_OTHERS else (t, k) for t, k in fill(line, d)]
        x = d.r.random()
        if x < 0.35:
            pieces = [(t if k == "email" else t.title() if k in ("name", "address") else t[:1].upper() + t[1:] if k is None and t[:1].isalpha() else t.upper() if k == "id_number" and d.r.random() < 0.6 else t, k) for t, k in pieces]
        elif x < 0.42:
            pieces = [(t.upper(), k) for t, k in pieces]
        elif x < 0.6:  # stripped of commas and full stops between sentences
            pieces = [(t.replace(";", " ").replace(":", " ") if k is None else t, k) for t, k in pieces]
        out.append(pieces)
    return out
