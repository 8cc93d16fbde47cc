"""The small labelled table from which the tagger of personal information is trained.

Each row is a query with slots; a slot stands for an item of its type, made by the rules below. Everything outside slots carries no label. The
table is expanded with a fixed seed, so training is the same everywhere.
"""

from __future__ import annotations

import random
import re

SENTENCES = 6000  # composed from words of messages and forms, for 16 copies of the rows
TYPES = ["email", "phone", "id_number", "address", "name"]

# fixed values: labelled rows; {w} is any word, {t} a town, {n} a small number
ROWS = """
who is {name} | wer ist {name} | find {name} | where does {name} live now | {name} obituary | {name} avis de décès | {name} divorce records
{name} high school photo | dr. {name} dentist reviews | mugshot of {name} | letter to {name} | {name} wedding {t} | {name} from {t} | {name} {w} {t}
{name} | {name} / {phone} | {name} - {address} | {name}: {email} | {name} and {address} | {name} lives at {address} | {name} {phone} | mr {name} lawyer {t}
qui est {name} | quién es {name} | chi è {name} | prof. {name} {w} | arrest record {name} | {name} linkedin | {name} facebook profile
{name} obituary {phone} | {name} wedding {t} cell {phone} | {name} from {t} tel. {phone} | dr. {name} dentist reviews {phone} | find {name} {phone}
{name} high school photo tel. {phone} | {name} divorce records cell {phone} | {name} avis de décès {phone} | letter to {name} tel. {phone}
{name} - who called me from {phone} | {name}: lost passport no {id} | {name} / social security number {id} {w} | {name} - map of {address}, {t}
{name}: reset password for {email} | {name} / write to {email} about {w} | {name}: who owns {email} | {name} - email {email} | {name} / {email} account hacked
{name} - e-mail adresse {email} gesperrt | {name}: directions to {address} | {name} lives at who lives at {address} | {name} and house for sale {address} {t}
{name} - {w} {t} tel {phone} | {name}: {id} {w} | {name} / nif {id} | {name}: dni {id} {w} | {name}: ssn {id}
email {email} | write to {email} about {w} | who owns {email} | reset password for {email} | {email} account hacked | e-mail adresse {email} gesperrt | {email}
{email} {w} | contact {email} | {w} {email} {w} | mail an {email} schicken | courriel {email}
who called me from {phone} | reverse lookup {phone} | phone {phone} | a qui est ce numéro {phone} | wem gehört {phone} | {phone} spam | {phone}
{w} {t} tel {phone} | {w} {t} tel {phone} | call {phone} {w} | telefon {phone} | tel. {phone} | {w} cell {phone} | de quién es {phone} | numero {phone}
ssn {id} | ssn# {id} | social security number {id} {w} | social security no {id} | lost {idword} {id} | {idword} {id} | {idword} {id} {w} | {idword} no {id} | {id} bank
lost {idword} {id} | {idword} {id} | {w} {idword} {id}
who lives at {address} | map of {address}, {t} | directions to {address} | {address} property tax | house for sale {address} {t} | wohnung {address} {t} | {address}
{address} {t} | {address}, {t} | apartment {address} | adresse {address} | rent {address} {t}
{w} | {w} {w} | {w} {w} {w} | {w} {w} {w} {w} | {w} {w} {w} {w} {w} | {w} {t} | {w} {w} {t} | {w} {n} | {w} {w} 20{n} | {w} {w} 19{n} {w} | how to {w} a {w} in {t}
{w} | {w} {w} | {w} {w} {w} | {w} {w} {w} {w} | {w} {w} {w} {w} {w} {t} | "{w}" {w} | {w}/{w},{w} {w} | {w}... {w}!! | {w}-{w} {w} | ({w}) {w} {w} {w}
{given} bakery | {given} bar | {given} hairstyle | {given} name meaning | {given} | {given} {w} | {family} coupons | {family} winery | {family} furniture | {family} | {family} {w} | "{family}" furniture
{given} {w} {w} | {w} {given} | {w} {family} {w} | {common} {w} {w} | {w} {common} {w} | {common} {common} {w} | {w} {common} {common} | {w} {w} {common} | {common} {w}
{family}, {w} | {family},winery | {w} {common} {t} | {common} {w} {w} 20{n} | {common}, {w} | {family} {t}
login at {host} | login at {hostdots} | {hostshort}/{w}@{d}x | {w} @ {t} {d} pm | {w}@{d}x | site:{host} {w} | {w} intitle:{w} site:{host} | related:{host} {w} {w} | cache:{host} {w}
how do i clean a {w} (at) home | {w} at {t} dot com | {w} at {w} dot
tracking {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} | isbn 978-0-{d}{d}{d}-{d}{d}{d}{d}{d}-{d} | {w} part no {d}{d}{d}-{d}{d}-{d}{d}{d}{d}k | {w} part no {d}{d}{d}-{d}{d}-{d}{d}{d}{d}z
lotto {n} {n} {n} {n} {n} | {w} version {d}.{d}.{d}{d}{d}.{n} | {w} version {n}.{d}.{d}{d}{d} | 192.0.2.{n} {w} | {d}{d}.{d}{d}.{d}.{n} | {w} {d}{d}{d} mm x {n} mm | {w} 20{n}-0{d}-1{d} | {w} {n}.0{d}.20{n}
{t} {d}{d}{d}{d}{d} zip code | {t} {d}{d}{d}{d}{d} | {w} {d}{d}{d}{d}{d}{d} | order {d}{d}{d}{d}{d}{d}{d}{d} | model {d}{d}{d}-{d}{d}{d} | {w} {n} {n} | serial no {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}
{n} hour {common} street parking {t} | {n} hour {w} street parking {t} | {n} avenue magazine {w} | {w} street {t} | {n} {w} street food | parking {w} street | rue {w} {t} | calle {w} | via {w} {t} | {w} avenue | {n} {w} {w}
{w} strasse | {w} gasse {t} | {w} allee {t} | {n} road trip {w} | {n} lane highway {w} | chapel street {t} | birch avenue | mühlenweg {t} | lindenstr. {t}
where to buy {w} at {host} | where to buy {w} {w} at {host} | {w} at {host} | buy {w} at {hostdots} | {w} {w} from {host} | download {w} from {host}
what is the difference between a {w} and a {w} {w} | which {w} do they use for the {w} in {t} {w} | my {w} fell on the {w} and now it will not open | can i carry a {w} and a {w} on the train to {t} {w} | who built the first {w} and when was it {w}
was ist der Unterschied zwischen einer {w} und einer {w} | wo kann man in {t} eine gebrauchte {w} kaufen {w} | meine {w} ist auf die {w} gefallen und geht nicht mehr auf | wie viel kostet eine neue {w} in {t} | darf die {w} im Winter draußen stehen | wer hat die erste {w} gebaut und wann {w}
la mia {w} è caduta sulla {w} e non si apre più {w} | qual è la migliore {w} per una piccola {w} | quanto costa una nuova {w} a {t} | dove si può comprare una {w} usata a {t} {w} | si può lasciare la {w} fuori durante l'inverno {w} | chi ha costruito la prima {w} e quando | perché la mia {w} fa uno strano rumore {w}
ma {w} est tombée sur la {w} et elle ne s'ouvre plus {w} | quelle est la meilleure {w} pour une petite {w} | où peut-on acheter une {w} d'occasion à {t} | combien coûte une nouvelle {w} à {t} | qui a fabriqué la première {w} et quand {w} | comment nettoyer une {w} à la maison
mi {w} se cayó sobre la {w} y ya no se abre | cuál es la mejor {w} para una {w} pequeña {w} | cuánto cuesta una {w} nueva en {t} {w} | se puede dejar la {w} fuera durante el invierno | quién hizo la primera {w} y en qué año {w} | por qué mi {w} hace un ruido tan extraño
mijn {w} is op de {w} gevallen en gaat niet meer open | wat is de beste {w} voor een kleine {w} | hoeveel kost een nieuwe {w} in {t} {w} | waar kan ik een tweedehands {w} kopen in {t} | wie heeft de eerste {w} gebouwd en wanneer {w} | hoe maak ik mijn {w} thuis schoon
мой {w} упал на {w} и больше не открывается | сколько стоит новый {w} в {t} | как почистить старый {w} в домашних условиях {w} | чем отличается {w} от вещи под названием {w} | где купить подержанный {w} в городе {t}
la mia {w} Ã¨ caduta sulla {w} e non si apre piÃ¹ | si puÃ² lasciare la {w} fuori | mÃ©tÃ©o {w} {t} | {w} fÃ¼r {w} | cuÃ¡l es la mejor {w}
house for sale {address} {t} | wohnung {address} {t} | {address} {t} | {name} and {address} {t} | {name} - wohnung {address} {t} | house for sale {address} {t}
map of {address}, {t} | {address}, {t} | map of {address}, {t} | who lives at {address} | {address} property tax | directions to {address} | {address} {t} | house for sale {address} {t} | wohnung {address} {t}
warum macht meine {w} so ein seltsames Geräusch {w} | waarom maakt mijn {w} zo'n vreemd geluid {w} | why does my {w} make such a strange noise | какой {w} лучше выбрать для дачи {w} | pourquoi ma {w} fait un bruit bizarre
@{w} {w} | @{common} {w} | {w}... {w} {w} | {w}... {w}, {w} | {w}, {w} {w} | {w}, {w} | {common}... {w} {w} | {w} {w}? | map of {w} | who is {name} {phone} | who is {name} tel. {phone} | {name}: a qui est ce numéro {phone} | {idword} {id} {w}
personalausweis {id} | personalausweis {id} {w} | lost personalausweis {id} | {name} - personalausweis {id} | {name} / personalausweis {id} {w} | codice fiscale {id} {w} | steuer-id {id} {w}
{phone} | {phone} | {phone} spam | {name}: {phone} | {name} / {phone} spam | {name} - {phone} | {name} wedding {t} {phone} | {name}: {phone} spam
directions to {address} | {address} property tax | {name}: {address} | {name} lives at {address} | {name} and wohnung {address} {t} | house for sale {address} {t} | {name} - {email} | {name} / {email} | {name}: {email}
call tel. {phone} | {name} {w} tel. {phone} | {w} {t} tel. {phone} | {name} obituary tel. {phone} | {name} wedding {t} tel. {phone}
{n} inch {w} | {n} days {w} | top {n} {w} | {w} {n} {w} | route {n} {w} | {w} {n}th | area code {d}{d}{d} | call {d}{d}{d} | dial 9{n} | {w} 1{n}-{d}{d}
"""

GIVEN = "anna jonas nadia felix clara hugo ines pavel greta milan tomas elena viktor marta leon rafael edith simon carla bruno olga david monika stefan teresa andre rosa karin martin laura lucia sofia petra julia oskar marek maria peter thomas paul eva lena jan luis pablo diego marie pierre jean luc sophie emma john mary james robert linda susan michael sarah kevin laszlo ivan nina igor yuri sven lars ingrid".split()
# given and family names that are common in several parts of the world
WORLD_GIVEN = "rajesh priya amit anil sunita vijay deepak arjun kavita kenji yuki hiroshi akira haruto sakura wei ming li jing xiao min-jun ji-woo fatima ahmed omar layla yusuf aisha hassan mohammed khalid zainab chidi amara kwame ngozi tunde abena mei lan nguyen linh somchai siti putri budi dmitri natalia sergei anastasia olena andrzej katarzyna piotr agnieszka jozef zsofia ferenc ioana mihai dragan jelena nikos eleni mehmet ayse emre zeynep bjorn astrid erik freya mikko aino giovanni francesca matteo chiara joao beatriz thiago camila santiago valentina mateo isabella jorge guadalupe william elizabeth charles jennifer richard patricia joseph barbara daniel nancy brian karen edward helen steven deborah siobhan declan alistair fiona gareth bronwen jurgen wolfgang heike jurgen sabine dieter ursula gunther anneliese etienne camille guillaume margaux".split()
WORLD_FAMILY = "kumar sharma patel singh gupta mehta rao iyer khan tanaka sato suzuki watanabe yamamoto kobayashi zhang wang chen liu yang huang kim park lee choi nguyen tran pham al-hassan el-sayed haddad mansour rahman hussein okafor adeyemi mensah diallo nkosi santoso wijaya petrov ivanova smirnov kowalski nowak wisniewska horvath nagy popescu ionescu jovanovic papadopoulos yilmaz demir kaya johansson lindqvist nielsen hansen virtanen korhonen rossi russo esposito colombo silva santos oliveira souza garcia rodriguez martinez lopez hernandez perez smith johnson williams brown jones miller davis wilson anderson taylor thompson white harris clark lewis walker young king wright scott green adams nelson carter mitchell roberts turner phillips campbell parker evans edwards murphy kelly o'brien macdonald müller schneider becker hoffmann wagner schäfer koch bauer richter klein wolf schröder dubois lefebvre moreau laurent girard bonnet de-vries jansen bakker visser".split()
_NAME_LEADS = "call|please call|ask for|contact|regards,|dear|sincerely,|attn:|meeting with|interview with|biography of|books by|signed by|my landlord is|my doctor is|the writer|attorney|herr|frau|mr|mrs.|ms|dr.|señora|sr.|madame|monsieur|signor|signora|patient|tenant:|manager:|kontakt:|ansprechpartner|von|por|de|mijn buurman|où habite|dove abita|dónde vive|is|was|did|met|email from|invoice to|message for|with".split("|")
_NAME_TAILS = "lawyer|obituary notice|married|net worth|age|reviews|lives here|called yesterday|called about the {w}|, born in {t}|, {t}|wrote the {w}|please|and family|verheiratet|est née à {t}|vive en {t}|thank you|at the {w}|owes me money|passed away|schedule|cv|thesis|moved to {t}".split("|")
_OTHER = {
    "email": ("my email is|send it to|reply to|e-mail:|mail|correo|schreib an|scrivi a|write me at|cc|contact|reach me at|or|newsletter for|unsubscribe", "thanks|asap|please|bounced|about the {w}|or call|for details|not working"),
    "phone": ("my number is|text|ring|fax|mobile|handy|phone:|tel|chiamare|llamar al|appeler le|bel|reach me at|or|whatsapp|call me on|hotline", "after {n}|please|thanks|for details|is busy|today|who is it"),
    "id_number": ("my {idword} is|{idword}:|{idword}|{idword} #|enter {idword}|valid {idword}|renew {idword}|{idword} nr.", "expired|please|is wrong|thanks|not accepted|copy"),
    "address": ("i live at|ship to|deliver to|send it to|wohnhaft|wohnt in der|habita en|j'habite|abito in|the office at|apartment at|fire at|meet me at|pizza to|our house,|lost near", ", {t}|, {t} {n}{n}|please|is for rent|on monday|third floor|, ring twice|{t}|for sale"),
}
_PLAIN = "please wait for the {w}|the {w} was closed on monday|we moved to {t} in 20{n}|can you send me the {w}|my {w} is {n} years old|reach the {w} before noon|thank you for the {w}|is there a {w} on main street|the red {w} street market|call the {w} office|mail the {w} to {t}|which road goes to {t}|the {w} at number {n}|order {d}{d}{d}{d}{d}{d} has not come|version {d}.{d} of the {w}|der {w} kommt aus {t}|die Straße nach {t} ist gesperrt|le {w} de {t}|el {w} está en {t}|il {w} di {t}|Main Street in {t}|Best {w} in {t}|The Great {w} of {t}|New {w} {w}|Paris Hotel {w}|Bank of {t}|University of {t}|dr. {w}|mr {w}|{n} avenue {w} {w}|{n} avenue {w}|{n} boulevard {w}|numbers {n} {n} {n} {n} {n}|author {w} {w}|{w} author {w}|meine {W} zu Hause {w}|die {W} zu Hause|die {W} von der {W} ist {w}|wie kann ich die {W} {w}|wenn der {W} nicht geht|für eine {W} in {t}|an der alten {W} {w}|laat de {w} buiten staan|voor een oude {w}|{family} {w}|{w} {family} {w}"

_LOOSE = "the a an at by in on near with from after before about and or for to of until tonight today tomorrow yesterday friday sunday morning stolen leaked lost found missing know knows complained met saw heard drop talk party neighbours anyone someone who does has have had was is are be been can could will would you your he she they we it this that there here then just only very again still bei am im an zum zur nach mit und oder der die das ein eine ist war wird hat chez au aux à la le les un une du est et ou avec pour dans en el los las con cerca del y o es fue tiene presso da il lo gli al alla e è con per bij op met naast het een van aan was heeft c'è l'ho dell' d'une qu'il s'est differenza tra fra che qual quale perché come quando dove wie wo wann warum qui quoi où quand comment cómo cuándo dónde alte alten neue neuen große kleinen petite vieille nouvelle vieja nueva pequeña vecchia nuova oude nieuwe Lampe Decke Schüssel Leiter wechseln reinigen ändern kosten machen changer nettoyer cambiar limpiar cambiare pulire".split()
_OPERATORS = "filetype:pdf|filetype:{w}|intext:{w}|intitle:{w}|allintitle:{w} {w}|related:{host}|cache:{host}|site:{host}|inurl:{w}".split("|")


def _around(r: random.Random) -> str:
    """Zero to three loose words."""
    return " ".join(r.choice(_LOOSE) if r.random() < 0.65 else "{w}" for _ in range(r.choice([0, 1, 1, 2, 2, 3])))


def _sentence(r: random.Random) -> str:
    """A row of plain words around one to three items, as people write them in messages and forms."""
    if r.random() < 0.4:
        parts = [r.choice(_PLAIN.split("|")), _around(r), r.choice(["{given}", "{family}", "{common}", "{w}"]), _around(r), r.choice(_OPERATORS) if r.random() < 0.4 else "{w}", r.choice(["{t}", "{w}", "{given}", "{common}"])]
        made = ""
        for part in r.sample(parts, r.randint(1, 5)):
            made += (r.choices([" ", ", ", ","], [85, 8, 7])[0] if made and part else "") + part
        return made or "{w}"
    parts = []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
        kind = r.choice(["name", "name", "name", "address", "phone", "email", "id_number"])
        leads, tails = (_NAME_LEADS, _NAME_TAILS) if kind == "name" else (x.split("|") for x in _OTHER[kind])
        lead = (r.choice(leads) if r.random() < 0.5 else _around(r)).strip() + " " if r.random() < 0.8 else ""
        tail = (r.choice(tails) if r.random() < 0.4 else _around(r)) if r.random() < 0.6 else ""
        lead = lead.lstrip()
        parts.append(lead + ("{id}" if kind == "id_number" else f"{{{kind}}}") + (tail if tail.startswith(",") else f" {tail}" if tail else ""))
    return r.choice([", ", " ", " - ", ". ", "; ", " / ", ": "]).join(parts)


STEMS = "vandr tolv krest mobr lindesk harv pell quist sorb drav ostrel fenn galv brisk wend zarr thull corv ander peters lind berg fisch schmid gonz ferr mart rod john will hend mol kov nov sob jank".split()
ENDS = "ellik anich orsen addick ingdal otti ovray usemann erbeck iotta anzade olmsen son sen mann berg er ez ari ini ic ov ova ski".split()
COMMON = "rose summer paris april river baker church bird lake rice anna bruno simon felix laura".split()
WORDS = "headache recipe bridge coupon cheap game office forecast dog laptop screen truck hours wedding music garden hotel price free download lyrics movie review jobs rates loan insurance tax school college degree salary history chemistry biology physics math cat horse spider bird fish snake animal pillow mattress lamp chair table sofa curtain carpet brake tire engine fuel driver car motorcycle boat flight ticket hotel beach island mountain weather wetter news notizie noticias horario prezzo receta recettes rezepte ricette купить скачать погода бесплатно billig gratis goedkoop kopen kaufen best new old large small red blue green black white quick easy near me what is how to the with for and in of vs best names quotes poem font clipart template form resume calculator translation dictionary crossword puzzle photos pictures wallpaper used company bank mortgage credit auction store shoes boots dress jacket hat watch guitar piano drum violin medicine allergy symptom vitamin pregnancy baby toddler nursery knitting quilt yoga exercise diet salad soup bread cake cookie chicken rice pasta cheese coffee tea water plumber dentist lawyer license records online local cast trailer song team league stadium score schedule museum theater castle church prayer baptism birthday party gift card costume halloween".split()
TOWN_A = "ne so ru gi mu pe zo lu bi ka sa ta fe du vi no bo li mo va ri ku de".split()
TOWN_B = "mere stad ville burg field ova ton heim".split()
HOSTS = ["example", "test", "invalid", "co.example", "com", "org", "de"]
ID_WORDS = ["passport", "passport number", "passport no", "reisepass", "numéro de passeport", "dni", "documento dni", "nif", "nino", "national insurance", "ni number", "steuer-id", "tax id number", "personalausweis", "codice fiscale", "ssn", "social security number", "social security no"]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _family(r: random.Random, family: list[str]) -> str:
    return r.choice(family) if family and r.random() < 0.5 else r.choice(STEMS) + r.choice(ENDS)


def _name(r: random.Random, given: list[str], family: list[str]) -> str:
    g, f = r.choice(given), _family(r, family)
    if r.random() < 0.3:
        g, f = r.choice(WORLD_GIVEN), r.choice(WORLD_FAMILY) if r.random() < 0.8 else f
    if r.random() < 0.12:
        f += "-" + _family(r, family)
    kind = r.random()
    middle = f" {r.choice('abcdefghijklmnoprstvw')}." if r.random() < 0.2 else ""
    if kind < 0.6:
        return f"{g}{middle} {f}"
    if kind < 0.8:
        return f"{f}, {g}"
    return f"{g[0]}. {f}" if kind < 0.95 else f"{f} {g}"


def _host(r: random.Random) -> str:
    name = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    name += r.choice(["", "", "hub", "web", "base", "x", "n", "s", "-mail", "web-mail", "hub-mail", "base-mail"])
    return ("mail." if r.random() < 0.08 else "post." if r.random() < 0.05 else "") + name + "." + r.choice(HOSTS)


def _email(r: random.Random, given: list[str], family: list[str]) -> str:
    g, f = r.choice(given), _family(r, family)
    user = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f[:4]}{_digits(r, 2)}", f"{g}+{r.choice(WORDS)}", f"{g[0]}{f}", f"{f}{_digits(r, 2)}", g, f"{g}{_digits(r, 2)}", f"{g}.{f[0]}"])
    host = _host(r)
    kind = r.random()
    if kind < 0.55:
        return f"{user}@{host}"
    if kind < 0.65:
        return f"{user} @ {host}"
    at = r.choice([" [at] ", "(at)", " at ", " (at) ", "[at]"])
    return user + at + (host.replace(".", " dot ") if r.random() < 0.6 or at == " at " and r.random() < 0.5 else host)


def _phone(r: random.Random) -> str:
    if r.random() < 0.25:  # a country or trunk prefix and groups of digits
        lead = r.choice(["+", "+", "00"]) + str(r.choice([31, 34, 39, 41, 43, 45, 46, 48, 61, 81, 91, 55, 7, 32, 351])) if r.random() < 0.6 else ""
        area = ("(0" + _digits(r, 2) + ")" if not lead and r.random() < 0.3 else ("" if lead else "0") + r.choice("123456789") + _digits(r, r.randint(1, 3)))
        sep = r.choice([" ", " ", "-", ".", "/"]) if not lead else " "
        rest = r.choice([_digits(r, 8), _digits(r, 7), f"{_digits(r, 4)} {_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)} {_digits(r, 2)} {_digits(r, 2)}"])
        return f"{lead}{' ' if lead else ''}{area}{sep}{rest}"
    a, b = r.choice("23456789") + _digits(r, 2), "0" + _digits(r, 3)
    e = r.choice(["555", "555", _digits(r, 3)])
    return r.choice([f"{a}-{e}-{b}", f"({a}) {e}-{b}", f"{a}.{e}.{b}", f"{a} {e} {b}", f"{a}{e}{b}", f"+1 {a} {e} {b}", f"+1-{a}-{e}-{b}", f"+44 7700 900{_digits(r, 3)}", f"07700 900{_digits(r, 3)}",
                     f"030 23125 {_digits(r, 3)}", f"+49 (0)30 23125-{_digits(r, 3)}", f"+49 30 23125{_digits(r, 3)}", f"+33 1 {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}"])


def _id(r: random.Random, word: str) -> str:
    if "pass" in word:
        return f"{r.choice('CDFGHJKL')}{_digits(r, 2)}{r.choice('TX')}{_digits(r, 2)}T{_digits(r, 2)}" if r.random() < 0.8 else r.choice("CFGHJK") + _digits(r, 8)
    if "dni" in word or "nif" in word:
        return _digits(r, 8) + r.choice(["", "-"]) + r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
    if word in ("nino", "national insurance", "ni number"):
        d = _digits(r, 6)
        return r.choice([f"QQ{d}{r.choice('ABCD')}", f"QQ {d[:2]} {d[2:4]} {d[4:]} {r.choice('ABCD')}"])
    if word in ("steuer-id", "tax id number", "personalausweis", "codice fiscale"):
        return r.choice([f"{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", _digits(r, 11)])
    d = "9" + _digits(r, 2)
    return r.choice([f"{d}-{_digits(r, 2)}-{_digits(r, 4)}", f"{d} {_digits(r, 2)} {_digits(r, 4)}"])


def _address(r: random.Random) -> str:
    n = str(r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(10, 99), r.randint(100, 999), r.randint(100, 999), r.randint(1000, 9999)]))
    tree = r.choice("orchard chapel birch willow foundry miller lark tannery heron quarry mill station park main oak elm hill bridge".split())
    kind = r.random()
    if r.random() < 0.55:
        any_ = "".join(r.choice("bdfgklmnprstvzñlr") + r.choice("aeiouüöáé") for _ in range(r.randint(2, 3))) + r.choice(["", "n", "r", "s", "x"])
        tree = r.choice([any_, r.choice(WORDS), r.choice("baker church king queen victoria washington lincoln maple cedar pine river lake high market school north south garden castle abbey".split()), r.choice(STEMS) + r.choice(ENDS), r.choice(WORLD_FAMILY)])
    if kind < 0.4:
        way = r.choice("street st avenue ave road rd drive dr lane ln court ct boulevard blvd street road avenue way place terrace close crescent square parkway".split()) + r.choice(["", "", "", "."])
        side = r.choice(["", "", "", "n ", "s ", "north ", "west ", "e ", "s. "])
        unit = r.choice(["", "", f" unit {r.randint(1, 40)}", f" apt {r.randint(1, 40)}", f" # {r.randint(1, 40)}", f" #{r.randint(1, 40)}", f", apt {r.randint(1, 40)}", f" apt. {r.randint(1, 9)}b"])
        return f"{n} {side}{tree} {way}{unit}"
    if kind < 0.6:
        stem = r.choice([r.choice("Birken Linden Mühlen Gerber Schul Garten Berg Kirch Haupt Rosen Wald Bahnhof Goethe Schiller Markt Wiesen Ring Dorf See Feld Bach".split()), (r.choice(STEMS) + r.choice(ENDS)).capitalize()])
        way = r.choice(["weg", "straße", "strasse", "str.", "gasse", "allee", "platz", "ring"])
        return f"{stem}{way} {n}{r.choice(['', '', 'a', 'b', ' b'])}"
    if kind < 0.82:
        way = r.choice(["rue", "avenue", "chemin", "boulevard", "av.", "allée"])
        rest = r.choice(["du Moulin", "des Tilleuls", "de la Carrière", "de l'Église", "des Lilas", "Victor Hugo", "de la République", "Jean Jaurès", "Pasteur", "des Écoles", "du " + r.choice(STEMS).capitalize() + r.choice(ENDS)])
        return f"{n}{r.choice(['', '', ' bis', ',', ','])} {way} {rest}"
    way, rest = r.choice([("calle", "Molino"), ("calle", "de la Alondra"), ("calle", "del Olmo"), ("avenida", "del Olmo"), ("avenida", "de la Alondra"), ("c/", "de la Alondra"), ("c/", "Molino"), ("plaza", "Mayor"), ("avda.", "del Molino"), ("via", "dei Salici"), ("via", "del Mulino"), ("viale", "dei Tigli"), ("corso", "Roma"), ("via", "Garibaldi")])
    return f"{way} {rest}{r.choice(['', '', ',', ' n.'])} {n}{r.choice(['', '', 'b'])}"


def _fill(r: random.Random, row: str, lexicon: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    ambiguous = set(COMMON[:10])
    given = GIVEN + [w.lower() for w, k in lexicon if k == "given" and w.lower() not in ambiguous]
    family = [w.lower() for w, k in lexicon if k == "family" and w.lower() not in ambiguous]
    text, spans, word = "", [], "ssn"
    for part in re.split(r"(\{\w+\})", row):
        slot = part[1:-1] if part.startswith("{") else None
        made = part
        if slot == "w":
            made = r.choice(WORDS) if r.random() < 0.75 else "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 3))) + r.choice(["", "x", "n", "r", "s"])
        elif slot == "W":
            made = (r.choice(WORDS) if r.random() < 0.5 else "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiouäöü") for _ in range(r.randint(2, 3)))).capitalize()
        elif slot == "t":
            made = (r.choice(TOWN_A) + r.choice(TOWN_A) + r.choice(TOWN_B)).capitalize()
        elif slot == "n":
            made = str(r.randint(10, 99))
        elif slot == "d":
            made = str(r.randint(0, 9))
        elif slot == "given":
            made = r.choice(given)
        elif slot == "family":
            made = _family(r, family)
        elif slot == "common":
            made = r.choice(COMMON)
        elif slot == "host":
            made = _host(r)
        elif slot == "hostdots":
            made = _host(r).replace(".", " dot ")
        elif slot == "hostshort":
            made = _host(r).split(".")[0] + ".example"
        elif slot == "idword":
            made = word = r.choice(ID_WORDS)
        elif slot in ("name", "email", "phone", "id", "address"):
            made = {"name": lambda: _name(r, given, family), "email": lambda: _email(r, given, family), "phone": lambda: _phone(r), "id": lambda: _id(r, _word_before(text, word)), "address": lambda: _address(r)}[slot]()
            spans.append((len(text), len(text) + len(made), "id_number" if slot == "id" else slot))
        text += made
    style = r.random()
    if style < 0.08:
        text2 = text.upper()
    elif style < 0.2:
        text2 = text.title()
    elif style < 0.5:
        text2 = text.lower()
    else:
        text2 = re.sub(r"(?<!\w)(\w)(\w+)", lambda m: m[1].upper() + m[2], text) if style < 0.56 else text
        if style >= 0.75:
            for a, b, kind in spans:
                if kind == "name" or kind == "address" and style > 0.85:
                    text2 = text2[:a] + text2[a:b].title() + text2[b:]
    return (text2 if len(text2) == len(text) else text), spans


def _word_before(text: str, word: str) -> str:
    low = text.lower()
    return next((w for w in ID_WORDS if low.rstrip().endswith(w)), "passport" if "passport" in low else word)


def expand(lexicon: list[tuple[str, str]], copies: int = 16, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) for every row of the table, several times over."""
    r = random.Random(seed)
    rows = [x.strip() for line in ROWS.strip().splitlines() for x in line.split(" | ")]
    made = [_fill(r, row, lexicon) for _ in range(copies) for row in rows]
    return made + [_fill(r, _sentence(r), lexicon) for _ in range(SENTENCES * copies // 16)]
