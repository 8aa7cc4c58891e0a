"""The labelled table that the personal-information model is trained on: marked-up lines in six languages, made up for
this purpose, with slots that are filled at random. ``[type:...]`` marks an item, ``{x}`` a slot."""

from __future__ import annotations

import random

import regex

LINES = 10_000  # rows drawn from the marked-up lines; the bound of the training sample

# Lines about the applicant: alone on a line, or with labels.
OWN = """
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}]
[name:{n}], {job}
[name:{n}] – {job}
{t} [name:{n}]
Name: [name:{n}]
Full name: [name:{n}]
Vor- und Nachname: [name:{n}]
Nom et prénom : [name:{n}]
Nombre: [name:{n}]
Nome: [name:{n}]
Naam: [name:{n}]
Applicant: [name:{n}]
CV of [name:{n}]
Résumé – [name:{n}]
Lebenslauf [name:{n}]
Lebenslauf von [name:{n}], Blatt {d1}
Currículum de [name:{n}]
Dossier de [name:{n}] ({d1}/{d1})
Curriculum di [name:{n}]
Application by [name:{n}], sheet {d1}
[name:{n}] / {d1}
[name:{n}] ({d1} of {d1})
[name:{n}] | Page {d1}
Page {d1} – [name:{n}]
Bewerbung [name:{n}] – Seite {d1}
Candidate file of [name:{n}] [{d1}]
""".strip().split("\n")
# Lines that name third persons, or give contact data within a sentence.
OTHERS = """
[name:{n}] led the {obj} before me.
[name:{n}] {past} the {obj} in {y}.
[name:{n}] {past} my {obj}.
[name:{n}] {past} {tail}.
[name:{n}] still {past} the {adj} {obj}, {tail}.
[name:{n}], who {past} the {obj}
Along with [name:{n}] and [name:{n}] I {past} the {obj} in {town}.
{v} {obj} for [name:{n}] and [name:{n}] {tail}.
{v} the {obj} with [name:{n}] {tail}
{v} {obj} under [name:{n}], later under [name:{n}]
Speak with [name:{n}] or [name:{n}] about the {obj}.
Call [name:{n}] or {t} [name:{n}] first.
Before {y} [name:{n}] {past} the {obj}.
{lower} of [name:{n}] and {lower} of [name:{n}]
Mit [name:{n}] und [name:{n}] in {town}
von [name:{n}] bestätigt
par [name:{n}] et [name:{n}], {town}
con [name:{n}] y [name:{n}] en {town}
[name:{n}] ([email:{e}], [phone:{p}])
[name:{n}], [address:{a}]
[name:{n}], [address:{a}]
{il2}: [name:{n}], [address:{a}]
The file at {il} [id_number:{i}] lapses in {y}.
Work visa for {il} [id_number:{i}]
{il} [id_number:{i}] | [email:{e}]
{il}: [id_number:{i}], issued in {town}
Sender: [name:{n}], [address:{a}], [phone:{p}]
{il2}: Frau [name:{n}], Tel. [phone:{p}]
{il2}: Herr [name:{n}], Tel.: [phone:{p}]
{il2} : Mme [name:{n}] ([phone:{p}]).
{il2} : M. [name:{n}], [email:{e}]
{il2} [phone:{p}] ([name:{n}])
{il2}: {t} [name:{n}]
{il2} [name:{n}]
Die Belege hat Frau [name:{n}], [address:{a}], aufbewahrt.
Das Lager von Herrn [name:{n}], [address:{a}], wurde aufgelöst.
My {rel}, {t} [name:{n}], {past} {tail}.
My {rel} then, [name:{n}], {past} the {obj}.
Mein {rel}, Herr [name:{n}], {tail}
Meine {rel}, Frau [name:{n}], {past}
{v} {obj}, {tail}, for [name:{n}], {job}.
{tail}, [name:{n}], {tail}
{lower} {lower} {lower} [name:{n}] {lower} {lower}
{lower} [name:{n}], [phone:{p}].
{v} [name:{n}], [phone:{p}], {tail}
für [name:{n}] während der {obj}
My line manager was {t} [name:{n}], who retired in {y}.
I deputised for [name:{n}] during two parental leaves.
Trained by [name:{n}] and later by [name:{n}].
References: [name:{n}], {job}, [phone:{p}]
Referees: [name:{n}]; [name:{n}]
Referee: [name:{n}] ([email:{e}])
First referee [name:{n}], [email:{e}], [phone:{p}]
In an emergency please call [name:{n}] on [phone:{p}].
In case of emergency: [phone:{p}] ([name:{n}])
You may phone my former manager {t} [name:{n}] at [phone:{p}].
Approved by [name:{n}]
Signed: [name:{n}]
Signature [name:{n}], {m} {y}
Countersigned by [name:{n}] and [name:{n}]
Handed over to [name:{n}] in {m} {y}.
[name:{n}] succeeded me as {job}.
[name:{n}] was my mentor there.
[name:{n}] and I shared the office for {d1} years.
[name:{n}], [phone:{p}]
[name:{n}] – [email:{e}]
[name:{n}] ([phone:{p}])
Worked with [name:{n}] on the {adj} {obj}.
Reporting line: {t} [name:{n}] (until {y})
Please direct questions to [name:{n}] ([email:{e}]).
For a copy of the papers write to [email:{e}] or call [phone:{p}].
Mail me at [email:{e}] any time.
Contact my office: [phone:{p}], Mondays only
My new number is [phone:{p}], the old one no longer works.
Reach me on [phone:{p}] after six.
Since {y} I have lived at [address:{a}].
Parcels go to [address:{a}], letters to [email:{e}].
We let a store room at [address:{a}] to a neighbour.
The interview took place at [address:{a}].
Residence permit {il} [id_number:{i}], renewed in {y}
Driving licence issued under {il} [id_number:{i}].
My {il} is [id_number:{i}].
Recommended by {t} [name:{n}], {org}
Manager: {t} [name:{n}], [phone:{p}], [email:{e}]
Ask for [name:{n}] or [name:{n}] at the front desk.
Spoke to [name:{n}] about the {obj}.
Spouse: [name:{n}]
Next of kin: [name:{n}], [phone:{p}]
Witness {t} [name:{n}]
Vorgesetzter war Herr [name:{n}], heute bei {org}.
Meine Vorgesetzte, Frau [name:{n}], erreichen Sie unter [phone:{p}].
Das Zeugnis unterschrieb [name:{n}] im {m} {y}.
Gemeinsam mit [name:{n}] habe ich die {adj} {obj} betreut.
Eingearbeitet durch [name:{n}]
Rückfragen bitte an [name:{n}], [email:{e}]
Rückfragen: Frau [name:{n}] ([phone:{p}])
Referenz: Dr. [name:{n}], [address:{a}], [phone:{p}]
Unterlagen bitte an [address:{a}].
Ich wohne seit {y} in der [address:{a}].
Ausweis {il} [id_number:{i}], gültig bis {y}
Notfallkontakt: [name:{n}], [phone:{p}]
gez. [name:{n}]
Kontakt Frau [name:{n}], [email:{e}]
Die Leitung übernahm danach Herr Prof. [name:{n}].
Sous la direction de Mme [name:{n}], {job}
Mon responsable était M. [name:{n}].
Responsable : M. [name:{n}], [phone:{p}]
Attestation signée par Mme [name:{n}] le {d2} {m} {y}
Formé par [name:{n}], puis par [name:{n}].
Personne à prévenir : [name:{n}] ([phone:{p}])
Écrire à [address:{a}] ou à [email:{e}].
J'habite au [address:{a}] depuis {y}.
Titre de séjour, {il} [id_number:{i}]
Joindre [name:{n}] au [phone:{p}] le matin.
Mi jefa fue la Sra. [name:{n}].
Jefe directo: Sr. [name:{n}], tel. [phone:{p}]
Informe firmado por [name:{n}] en {m} de {y}
Llamar a [name:{n}], [phone:{p}]
Trabajé junto a [name:{n}] y [name:{n}].
Vivo en [address:{a}].
Documento {il} [id_number:{i}], vigente hasta {y}
Persona de contacto: D. [name:{n}], [email:{e}]
Il mio responsabile era il Dott. [name:{n}].
Referente: Sig.ra [name:{n}], tel. [phone:{p}]
Abito in [address:{a}] dal {y}.
Firmato da [name:{n}]
Mijn leidinggevende was mevrouw [name:{n}], [phone:{p}].
Ingewerkt door [name:{n}]
Getekend: [name:{n}], {m} {y}
""".strip().split("\n")
# Lines without any personal item.
PLAIN = """
{org} – {job}, {town} ({m} {y} – {m} {y})
{org} | {job} | {y} - {y}
{org} | {job} | {m}. {y} – {m}. {y}
{org} | {job}, {town} | {d1}/{y} – {d1}/{y}
{org}, {town} | {job} | {y}-0{d1} – today
{org} | {job} | {dt} – {dt}
{org} {legal} | {job} ({x}) | {dt} – {dt}
{org}, {town} | {job} - {x} | {dt} – {dt}
{w} {w} {trade} {legal} | {job} | {dt} – {dt}
{acr} | {job} | {dt} – {dt}
{job}, {org} | {dt} – {dt}
{job} | {dt} – {dt}
{dt} – {dt}
{dt} – {dt}: {job}
{dt}
{job} at {org} since {y}
{job} @ {org} | {y} to date
{job}, {org}, {town}
{job} | {org} | {m} {y} - {m} {y}
{job} | {y}–{y}
{w} | {job} | {y} – {y}
{w} {w} | {job} | {m} {y} – {m} {y}
{w} {w} | {job} ({x}) | {y} – {y}
{w} & {w} {trade} | {job} | {m} {y} – {m} {y}
{trade}, {w} {w} | {job}, {town} | {d1} {m} {y} – {m} {y}
{acr} | {job} | {y} – {m} {d2}
The {w} {w} {trade} Group | {job} | {m} {y} – {m} {y}
{m} {y} – {m} {y} {job}, {org}
{y}–{y} {org}, {town}
{org} {legal}, branch {town}
{job}
{job} ({x})
{trade} {job}
{school}, {town}, {y}
{degree}, {school}, {y}
{degree} in {k}, {school} ({y} – {y})
Graduated {m} {y}, {school}
{v} {adj} {obj}
{v} {adj} {obj} {tail}
{v} {adj} {obj} {tail}.
• {v} {obj} {tail}
- {v} {adj} {obj} {tail}.
* {v} the {obj} and the {obj} {tail}
{obj} {tail}. {v} {adj}
{obj} and {obj}
{tail}.
{tail}
{adj} {obj} {tail}, which cut costs by {d2} percent
{v} {adj} {obj}, {obj} and {obj} {tail}.
{v} {obj} for {org}
{lower}
{lower} {lower}
{lower}.
{lower}. {v} {adj} {obj}
of {adj} {obj} {tail}
and {obj} {tail}. {v}
{k}
{k},{k},{k}
{k},{k},{k},{k}
{k}, {k}, {k}
{skl} – {k} - {k} - {k}
{skl}: {k},, {k}, {k},
{skl}: {k} / {k}; {k}
{skl}: {g}, {g}, {g}
{skl}: {g}, {w}, {g}, {w}
{g}, {g}, {g}
{w}, {w}, {w}
{skl}: {w}, {w}
{g} / {g}
{town} {town}
{town}, {town}, {town}
{v} the {w} {w} {trade} in {y}.
{v} the {w} {club}
{d3},{d3} {cur}
{d1},{d3},{d3} to {d1},{d3},{d3} {cur}
{cur} {d3}.{d3},{d2}
{obj} {y}/{d2}: {d3},{d3} {cur}
{d4} {lower}, {d2} percent {tail}
No. {d2}-{d4}-{d1}, {adj} {obj}
{w} {trade}, {k}, {w}
{w} Suite, {k}, {w} Platform, {k}
{w} Suite - {k} - {w} Pro
{k}; {k}; {k}
{k} | {k} | {k}
{k} • {k} • {k} • {k}
{k} / {k} / {k}
{k}, {k} and {k}
{k} & {k}
{skl}: {k}, {k}, {k}, {k}
{skl}: {k} | {k} | {k}
{skl} {k}, {k}
{skl} – "{k}", "{k}"
{skl} {k}; {k}
{k} ({lvl}), {k} ({lvl})
{k}	{k}	{k}
{w}, {w}, {k}
{w} [v{d1}, v{d1}], {k}
{w} ({lower}; {lower}), {k}
{h}
{h}
{h}
{h}:
{H}
{H}
{h} and {h}
{h} –
{lang}: {lvl}
{lang} ({lvl}), {lang} ({lvl})
Output grew from {d2},{d3} to {d2},{d3} pieces a month.
Turnover {y}: {d1}.{d1} million, {d3} customers
Invoice {d4}-{d4} was settled in {m}.
Purchase order PO-{d6} over {d4} units
Ticket #{d6} closed after {d2} minutes
Case {acr}-{d4}-{d2} was closed in {m}.
File number {acr}-{d4}-{d2}, part {d1}
Contract no. {acr}{d2}-{d4} over {d2} months
{v} order {d4}-{d2} {tail}
Type {acr} {d4}/{d2}, series {d3}
Shelf {d4}-{d4}, aisle {d2}
Sensor {lower}@{d1}.{d1} replaced
Grade {d1}.{d1} ({dt})
Course no. {d5}, {dt}
Diploma of {dt}
Version {d1}.{d2}.{d1}-{d4} rolled out to {d3} terminals
Upgraded to release {d1}.{d2} and build {d6}.
Audit according to ISO {d4}:{y}, clause {d1}.{d1}
DIN EN {d5}-{d1} and {d4} applied
Sheet {d4}-{d3}, grid {d2}-{d4}
Batch {d4}/{d2}, lot {d5}
Room {d3}, building {d1}, open 24/7
Opening hours 08:00-16:30, {d2} seats
Coordinates {d2}.{d4}, {d1}.{d5}
Charged EUR {d3}.{d2} per hour, {d4} hours in total
Budget of USD {d1},{d3},{d3} in {y}/{d2}
{d4} accident-free days by {m} {y}
ISBN 978-{d1}-{d4}-{d4}-{d1}
Pinged @{lower}_{lower} and sensor@{d1}.{d1}
Followed @{lower} on the {lower} channel
Rate 3@{d2} and 5@{d2} agreed
Account class {d4}, cost centre {d5}
{d2}.{d2}.{y} – {d2}.{d2}.{y}
{m} {y} – {m} {y}
{y} – {y}
Page {d1}
Page {d1} of {d1}
Seite {d1}
Seite {d1} von {d1}
Página {d1} de {d1}
{d1}
{d1} / {d1}
- {d1} -
[{d1}]
Confidential – do not copy
Attachment {d1}: certificates
Anlagen: Zeugnisse
Curriculum Vitae
CURRICULUM VITAE
Lebenslauf
Personal file, {town} office
{town} Job Centre – collected papers
Shared folder of all applicants
{town}
{town}, {m} {y}
{town} and {town}
Willing to move to {town} or {town}.
Member of the {town} {club} since {y}.
Volunteer at the {town} {club}, {y}–{y}
Opened the {town} branch in {y} and the {town} branch in {y}.
Moved from {org} to {org} in {y}.
Clients such as {org}, {org} {legal} and {w} {trade}
Project {w}: {adj} {obj}
Team {w}
Team {w}, later {w} {trade}
Old {w} {trade}
Prize of the {w} Foundation, {y}
Certified by {org} in {y}
{v} mit {d2} Beschäftigten die {adj} {obj}.
Gestion des {obj} et des {obj} à {town}
Coordiné {obj} y {obj} en {town}
Verantwortlich für {obj} in {town} und {town}
Responsable de {obj} chez {org}
Available from {m} {y}
Verfügbar ab {m} {y}
Born in {y}
Married, two children
Driving licence class B
Führerschein Klasse B, C1
Hobbies: {lower}, {lower}, {lower}
""".strip("\n").split("\n")
FIRST = """Adam Agnes Albert Alice Amelie Amir Ana Andrea Andrew Anja Anna Antoine Anton Ayşe Barbara Beatriz Ben Bernd Björn Bruno Camille Carla Carlos
Caroline Charles Charlotte Chiara Chloé Christian Claire Clara Claudia Daniel David Diana Diego Dirk Elena Elif Elisa Elizabeth Emil Emily Emma Eric Erik Esther Eva
Fatima Felix Fernando Florian François Frank Frieda Friedrich Gabriel George Gerd Giulia Grace Greta Hannah Hans Harry Heike Helen Helga Henri Henry Hugo Igor Ines
Ingrid Isabel Ivan Jacques James Jan Jane Javier Jean Jennifer Jens João Johanna John Jonas Jorge José Juan Julia Jürgen Karin Karl Katarzyna Katrin Kevin Klaus Lars
Laura Leila Lena Leo Linda Lisa Louis Luca Lucía Luis Łukasz Magda Manuel Marc Margaret Maria Marie Mark Marta Martin Mary Matteo Matthias Max Michael Miguel Mia Mohammed
Monika Nadia Nicolas Nina Noah Nora Olga Oliver Olivier Omar Oscar Otto Pablo Paul Paula Pedro Peter Petra Philippe Pierre Priya Rachel Rafael Ravi Richard Robert Rosa
Ruth Samantha Samuel Sandra Sara Sebastian Sofia Søren Stefan Susan Sven Thomas Tim Tobias Tom Ursula Vera Victor Walter William Wolfgang Yara Yusuf Zoé""".split()
# Common family names of several languages; most of those drawn are put together from syllables.
LAST = """Schmidt Weber Wagner Becker Hoffmann Schulz Koch Richter Klein Wolf Neumann Schwarz Zimmermann Krüger Hartmann Lange Krause Meier Lehmann Köhler Martin Bernard Dubois
Laurent Moreau Girard Lefèvre Mercier Dupont Fontaine Rousseau Garnier García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Díaz Romero Navarro Torres
Smith Johnson Brown Taylor Wilson Evans Thompson Walker Wright Robinson Green Hughes Edwards Turner Parker Cooper Bennett Fletcher Rossi Ferrari Esposito Bianchi Romano
Colombo Ricci Conti Stone Wood Field Rivers Shepherd Mason Fisher Knight Page Day Young King Rose Berg Sommer Winter Vogel Fuchs Müller Fischer Bauer Schneider Nowak Kowalski Wiśniewski Kaya Yılmaz Demir Silva Santos Oliveira Costa Jansen Bakker Visser Hansen Nielsen Larsen Olsen Petrov Ivanov Novák Horváth""".split()
FIXED = {
    "job": """Accountant|Baker|Bricklayer|Bus Driver|Carpenter|Care Assistant|Head of Sales|Chef de Partie|Chemist|Claims Handler|Copy Editor|Crane Operator|Customer Adviser|Data Engineer|Dental Nurse|Draughtsman|Electrician|Estate Agent|Event Planner|Field Engineer|Fitter|Florist|Forklift Driver|Gardener|Graphic Designer|Hotel Manager|HR Officer|Interpreter|Junior Developer|Lab Technician|Lecturer|Legal Assistant|Librarian|Lift Mechanic|Logistics Clerk|Machine Operator|Marketing Manager|Midwife|Nursery Teacher|Office Manager|Optician|Painter|Pharmacist|Photographer|Physiotherapist|Pilot|Plumber|Process Engineer|Product Owner|Purchasing Agent|Quality Inspector|Receptionist|Research Fellow|Roofer|Sales Assistant|Security Guard|Senior Analyst|Shift Leader|Social Worker|Software Architect|Sous Chef|Store Manager|Surveyor|Tax Adviser|Team Leader|Translator|Travel Agent|Tutor|Waiter|Warehouse Worker|Web Developer|Welder|Zookeeper|Buchhalterin|Bäcker|Elektriker|Krankenpfleger|Sachbearbeiterin|Vertriebsleiter|Werkstudent|Comptable|Infirmière|Serveur|Vendeuse|Contable|Enfermera|Camarero|Ingeniero de obra|career break|internship|night porter|Site Manager|Chief Steward|Line Manager|Stage Technician|Costume Designer|Media Planner|Soil Engineer""".split("|"),
    "trade": "Logistics Foods Systems Engineering Insurance Transport Energy Consulting Retail Services Partners Industries Software Media Pharma Textiles Shipping Bank Holding Motors Health Publishing Construction Laboratories Works Technologies".split(),
    "legal": "GmbH AG Ltd plc Inc. LLC S.A. SARL S.L. BV NV Oy AB KG e.V. S.p.A.".split(),
    "t": ["Mr", "Mrs", "Ms", "Mr.", "Mrs.", "Ms.", "Dr", "Dr.", "Prof.", "Prof. Dr.", "Herr", "Frau", "M.", "Mme", "Mlle", "Sr.", "Sra.", "Sig.", "Sir"],
    "m": "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sept Oct Nov Dec Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril juin juillet août octobre décembre enero febrero marzo abril junio julio agosto septiembre octubre".split(),
    "v": "Advised Analysed Arranged Assembled Audited Built Calculated Checked Cleaned Coached Collected Configured Coordinated Created Cut Delivered Developed Drafted Established Evaluated Expanded Handled Implemented Increased Installed Instructed Investigated Led Maintained Mapped Measured Migrated Moderated Negotiated Operated Organised Oversaw Packed Planned Processed Programmed Provided Purchased Recorded Reduced Repaired Represented Rewrote Served Sold Solved Sorted Tested Trained Translated Wrote Betreute Leitete Plante Organisierte Encadré Géré Conçu Dirigí Organicé".split(),
    "adj": "annual careful complete complex daily digital external final flexible foreign former general global important internal joint large local main manual medical mobile monthly modern national new older online outdoor public rapid regular remote safe short simple small special technical urgent urban weekly neuen internen externe principales".split(),
    "obj": "accounts|archives|bookings|budgets|building sites|bus routes|cash registers|catalogues|client visits|cold stores|complaints|contracts|courses|customer orders|databases|deadlines|deliveries|documents|drawings|events|exams|fittings|forecasts|forms|guest lists|interviews|invoices|kitchens|ledgers|lessons|lists of parts|machines|manuals|meetings|menus|orders|parcels|patient files|payments|plans|price lists|purchases|records|repairs|reports|rosters|safety checks|samples|schedules|shifts|shipments|stock counts|surveys|tenders|test runs|timetables|tools|training sessions|translations|vehicles|warehouses|websites|wages|workshops|Bestellungen|Verträge|Rechnungen|Schichtpläne|dossiers|commandes|pedidos|facturas".split("|"),
    "tail": "across three sites|after a merger|as deputy head|ahead of schedule|at short notice|by hand|by agreed dates|for all branches|for a staff of 40|for local schools|for the whole region|in cooperation with suppliers|in two languages|on behalf of the board|on three continents|together with a partner firm|under strict hygiene rules|under supervision|using a new system|with a small team|with the help of volunteers|within one year|within budget|without any loss|so that nobody waited longer than needed|and cut the backlog by half|which saved 12 percent|that met all rules".split("|"),
    "k": "Bookkeeping|Carpentry|Excel|First Responder|Lathe Work|Photo Editing|Public Speaking|Python|SQL|Java|Docker|Team Work|Time Management|Stock Control|Food Safety|Network Security|Machine Learning|Customer Service|Price Analysis|Contract Law|Payroll|Tax Law|Project Planning|Risk Assessment|Plant Care|Child Care|Wound Care|Blood Sampling|Choir Singing|Sound Design|Light Design|Set Building|Sewing|Pattern Cutting|Bread Making|Wine Tasting|Menu Design|Bar Service|Event Security|Forklift Licence|Pipe Fitting|Tiling|Roofing|Plastering|Brick Laying|Soil Analysis|Land Survey|Map Reading|Tree Felling|Animal Care|Fish Farming|Music Theory|Film Editing|Text Editing|Proof Reading|Cash Handling|Shop Display|Market Research|Brand Design|Web Design|Test Automation|Data Entry|Data Modelling|Cloud Hosting|Rest APIs|C++|R|SAP|AutoCAD|CNC|MIG Welding|Fire Safety|Noise Control|Waste Management|Water Treatment|Solar Power|Wind Energy|Metal Work|Wood Work|Leather Work|Glass Blowing|conflict resolution|crisis communication|grant writing|route planning|quality control|negotiation|mentoring|dance teaching|vector graphics|Buchführung|Personalführung|Lagerhaltung|Gestion de projet|Service en salle|Atención al cliente|Contabilidad|Ocr|Crm|Hris|Gis|Plc".split("|"),
    "h": "About|Awards|Career History|Certificates|Contact|Core Skills|Courses|Education|Employment|Employment History|Experience|Further Training|Hobbies|Interests|Key Achievements|Key Skills|Knowledge|Languages|Memberships|Objective|Other Activities|Personal Data|Personal Profile|Personal Statement|Professional Experience|Professional Summary|Projects|Publications|Qualifications|References|School Education|Skills|Soft Skills|Strengths|Studies|Summary|Technical Skills|Tools|Training|Volunteering|Work Experience|Work History|Ausbildung|Berufserfahrung|Beruflicher Werdegang|Bildungsweg|Fähigkeiten|Kenntnisse|Kompetenzen|Persönliche Daten|Praktika|Schulbildung|Sprachen|Sprachkenntnisse|Weiterbildung|Compétences|Expérience professionnelle|Formation|Langues|Loisirs|Centres d'intérêt|Profil|Experiencia laboral|Formación académica|Habilidades|Idiomas|Perfil profesional|Competenze|Esperienza|Istruzione|Opleiding|Werkervaring|Vaardigheden".split("|"),
    "skl": "Skills|Core skills|Expertise|Methods|Programs|Software|Tools|Technology|Strong in|Also|Kenntnisse|Stärken|Werkzeuge|Logiciels|Compétences|Programas|Aptitudes|Strumenti|Vaardigheden|Tools and software".split("|"),
    "lvl": "fluent|native|basic|advanced|good|expert|B1|C1|A2|Muttersprache|courant|nivel alto".split("|"), "lang": "English German French Spanish Italian Dutch Polish Turkish Arabic Deutsch Englisch Français Español".split(),
    "degree": "BSc|MSc|B.A.|M.A.|MBA|Diploma|Bachelor|Master|PhD|Abitur|Licence|Grado|Baccalauréat".split("|"), "x": ["temp", "part time", "m/f/d", "contract", "full-time", "intern", "Teilzeit"],
    "club": "Rowing Club|Choir|Library|Chess Club|Animal Shelter|Fire Brigade|Food Bank|Football Club|Garden Club|Historical Society|Theatre|Youth Centre".split("|"),
    "lower": "branches customers colleagues consultants departments districts guests helpers inspectors municipalities neighbours partners pupils suppliers visitors volunteers budget records purposes lists reading hiking chess cooking music floor alerts news core admin rain snow level weeks orders".split(),
    "g": "Baking Brewing Carving Climbing Coding Dancing Diving Drawing Driving Editing Farming Fishing Framing Gluing Grinding Hiring Ironing Knitting Mixing Mowing Packing Polishing Printing Riding Rigging Sailing Sanding Skiing Sorting Spraying Stitching Tuning Weaving Wiring Backen Bohren Kochen Löten Malen Nähen Sägen Linux Oracle Matlab Blender Ansible Kotlin Excel Unix".split(),
    "cur": "EUR USD GBP CHF euros dollars pounds Euro € $".split(), "rel": "Ausbilder Chef Chefin Kollege Kollegin Leiterin adviser assistant captain coach deputy director foreman partner predecessor professor successor superior trainer tutor".split(),
    "past": "approved ended left led managed opened planned prepared ran rebuilt reviewed sold started took tested trained wrote handled".split(),
    "il2": "Contact|Contact person|Emergency|Referee|Reference|Responsible|Head of team|Superior|Ansprechpartner|Kontakt|Leitung|Vorgesetzte|Responsable|Référence|Collègue|Contacto|Referencia|Referente|Responsabile|Contactpersoon".split("|"),
    "il": "Passport|Passport no.|Passport No|ID|ID no.|ID number|Identity card|National ID|National insurance number|NI number|Social security number|SSN|SSN:|Tax ID|Tax number|Steuernummer|Steuer-ID|Steueridentifikationsnummer|Personalausweis|Personalausweis Nr.|Reisepass|Sozialversicherungsnummer|Carte d'identité|Carte d'identité n°|N° de sécurité sociale|Passeport n°|DNI|DNI:|NIE|NIF|Pasaporte|Codice fiscale|BSN|Personnummer|PESEL|Personal no.|Employee tax ref.".split("|"),
    "el": ["", "", "", "E-mail: ", "Email: ", "e-mail ", "Mail: ", "mail ", "E: ", "Courriel : ", "Correo: ", "✉ ", "E-Mail-Adresse: "],
    "pl": ["", "", "", "Tel. ", "Tel.: ", "Tel: ", "Phone: ", "Phone ", "Mobile: ", "Mobil ", "Cell: ", "M: ", "Fon: ", "Telefon: ", "Tél. : ", "Tél. ", "Teléfono: ", "☎ ", "Handy "],
    "al": ["", "", "", "Address: ", "Home address: ", "Adresse: ", "Adresse : ", "Anschrift: ", "Dirección: ", "wohnhaft ", "Indirizzo: ", "Residence: ", "✉ "],
    "sep": [" | ", " | ", "; ", "  ", "   ", " · ", " • ", ", ", " / ", " – ", "\t"],
    "road": "Street Road Lane Avenue Close Drive Square Terrace Court Way Gardens Hill Crescent Boulevard St. Rd Ave".split(),
    "strasse": "straße str. weg gasse allee platz ring damm ufer steig".split(),
    "rue": ["rue", "rue de", "rue du", "rue des", "avenue", "avenue de la", "boulevard", "place", "impasse", "chemin des", "quai"],
    "calle": ["Calle", "C/", "Avda.", "Avenida", "Plaza", "Paseo", "Via", "Viale", "Rua", "Ctra."],
}
_HEADS = "al an ar bel ber bra bren bur cal cor dan del dor dra el er fal fen fer gar gol gra hal har hen hol is jar jor kal kar kel kor lan lar lin lom mal mar mel mor nar nel nor ol or os pal per pol quin ral ren ros sal san sel sten tal tar tor ul val var vel ver wal wen wil yar zan zel".split()
_MIDS = "a e i o an en in on ar er or al el il ad ed ast est ist ov ev em om und ick".split()
_TAILS = "berg burg dale den er ez field ford gard garth ham haus hurst ik in inen ingen ka ko land ley lin low man mann mere mond nen ner ney ova ovic off oux quist sen shaw ski ska son stad stein stead ström ton ton vic ville wald wick wood worth elli ini aud eux ard ides owa gartner stätter müller macher ler inger onin aev enko chuk iak czyk escu akis opoulos oglu yan ero ada ales eira inho ez uez etti ucci one ier eau ault ois court villier aert mans stra ema sson dóttir lund gren dahl holm feather combe bury well ham croft cott bridge".split()

_SKILL = (
    "Account Air Animal Bank Battery Boat Brand Bridge Budget Business Cable Call Cargo Cash Chemical Claim Clinical Coast Colour Concrete Consumer Copper Costume Crane Credit Crop Dairy Debt Digital Door Drug Energy Engine Export Fabric Factory Family Fibre Field Fish Fleet Forest Freight Fruit Garden Gas Glass Grain Harbour Heat Import Insurance Job Kitchen Labour Land Laser Legal Light Machine Mail Medical Metal Milk Museum Office Oil Paint Paper Patient Plant Pool Power Press Price Print Rail Rescue Road Rock Safety School Sea Seed Ship Silk Site Skin Snow Social Spare Stage Steel Stone Street Supply Textile Ticket Timber Tool Town Trade Traffic Travel Tree Truck Vendor Vessel Video Voice Wage Wall Warehouse Waste Wire Wool".split(),
    "Administration Advice Assembly Assessment Brokerage Building Care Checks Classification Collection Compliance Conservation Control Coordination Counselling Dispatch Drafting Engineering Estimation Evaluation Forecasting Handling Hygiene Illustration Inspection Installation Law Lending Logistics Maintenance Management Mapping Marketing Modelling Monitoring Operation Optimisation Ordering Packing Planning Preservation Pricing Procurement Production Programming Protection Purchasing Recovery Recycling Regulation Relations Removal Repair Reporting Research Restoration Sales Sampling Scheduling Security Support Testing Therapy Training Transport Treatment Upkeep Valuation Writing".split(),
)


class Table:
    """Draws the labelled table from the marked-up lines."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, key: str) -> str:
        return self.r.choice(FIXED[key])

    def invented(self) -> str:
        r = self.r
        return (r.choice(_HEADS) + (r.choice(_MIDS) if r.random() < 0.6 else "") + r.choice(_TAILS)).capitalize()

    def word(self) -> str:
        """A made-up brand or place word, without the endings of family names."""
        r = self.r
        return "".join(r.choice(_HEADS) + r.choice("aeiou") * (r.random() < 0.5) for _ in range(r.choice((1, 2, 2, 2)))).capitalize() + r.choice(["", "", "o", "um", "ex", "ix", "t", "d", "a"])

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def first(self) -> str:
        r = self.r
        return r.choice(FIRST) if r.random() < 0.6 else (r.choice(_HEADS) + r.choice(_MIDS)[:1] + r.choice(["", "n", "s", "la", "na", "ra", "ko", "mir", "lie", "vin", "ta", "sz", "ne", "di", "do", "rt", "ah", "jan", "ar"])).capitalize()

    def last(self) -> str:
        r = self.r
        if r.random() < 0.12:  # open syllables, as in many languages outside Europe
            return "".join(r.choice("k t s n m r b d g ch sh y w z kw ng j p nd mb".split()) + r.choice("a e i o u".split()) for _ in range(r.choice((2, 3, 3)))).capitalize() + r.choice(["", "", "n", "ng", "h", "r"])
        return r.choice(LAST) if r.random() < 0.3 else self.invented()

    def name(self) -> str:
        r = self.r
        first, last = self.first(), self.last()
        k = r.random()
        if k < 0.05:
            first = self.r.choice(["Jo", "Bo", "Lea", "Ron", "Pia", "Gil", "Mia", "Ida", "Kai", "Tim", "Eva", "Uwe"])
        elif k < 0.1:
            first += "-" + self.first()
        elif k < 0.2:
            first += " " + self.first()
        elif k < 0.3:
            first += f" {r.choice('ABCDEFGHJKLMNPRSTVW')}."
        if r.random() < 0.1:
            last += "-" + self.last()
        elif r.random() < 0.12:
            last = r.choice(["van ", "van der ", "de ", "de la ", "del ", "von ", "zu ", "di ", "O'", "O’", "Mac", "Mc", "El ", "dos "]) + last
        k = r.random()
        out = f"{last}, {first}" if k < 0.08 else f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWZ')}. {last}" if k < 0.2 else f"{first} {last}"
        return out.upper() if r.random() < 0.1 else out

    def email(self) -> str:
        r = self.r
        first, last = regex.sub(r"\W", "", self.first().lower()), regex.sub(r"\W", "", self.last().lower())
        user = r.choice([f"{first}.{last}", f"{first}{last}", f"{last}{self.d(2)}", f"{first[0]}{last}", f"{first}-{last}", f"{first}_{last}", f"{last}.{first}", f"{last}_{first[0]}{self.d(2)}", f"{first}.{last}{self.d(1)}", f"{first}.{last}+cv", f"{first[0]}.{last}", f"{first}{self.d(4)}", "info", "office", "jobs"])
        host = f"{r.choice([self.word().lower(), 'mail', 'post', 'web', 'uni-' + self.word().lower(), self.word().lower() + '-' + self.word().lower()])}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'it', 'ch', 'co.uk', 'eu', 'nl', 'test', 'example', 'edu', 'info', 'io'])}"
        if r.random() < 0.2:
            host = f"{r.choice(['mail', 'in', 'staff', 'students', 'inbox'])}.{host}"
        k = r.random()
        if k < 0.06:
            return f"{user} [at] {host}"
        if k < 0.12:
            return f"{user} {r.choice(['AT', 'at'])} {host.replace('.', r.choice([' DOT ', ' dot ']))}" if k < 0.1 else f"{user} AT {host.replace('.', ' DOT ')}"
        if k < 0.18:
            return f"{user}(at){host.replace('.', r.choice(['(dot)', '.']))}"
        if k < 0.2:
            return f"{user} @ {host}"
        out = f"{user}@{host}"
        return out.upper() if k > 0.94 else out

    def phone(self) -> str:
        r, d = self.r, self.d
        c = r.choice(["49", "44", "33", "34", "39", "31", "41", "43", "1", "48", "351", "90", "46"])
        gap = r.choice([" ", " ", "-", ".", "/", " - "])
        return r.choice([
            f"+{c} {d(2)} {d(7)}", f"+{c} {d(3)} {d(3)} {d(3)}", f"+{c} (0){d(2)} {d(6)}", f"+{c} (0) {d(3)} {d(4)}-{d(2)}", f"+{c}{gap}{d(3)}{gap}{d(4)}", f"00{c} {d(2)} {d(3)} {d(4)}", f"00{c}-{d(3)}-{d(6)}", f"+{c}{d(9)}",
            f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(6)}", f"0{d(3)} {d(6)}", f"0{d(4)}-{d(5)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(2)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}",
            f"+1 {d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(4)} ext. {d(2)}", f"{d(3)}-{d(4)}, ext. {d(3)}", f"+44 (0) {d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"(0{d(2)}) {d(7)}", f"(+{c}) {d(3)} {d(6)}", f"+{c} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}{gap}{d(4)}{gap}{d(3)}",
        ])

    def number(self) -> str:
        r, d = self.r, self.d
        c = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}-{c()}", f"{d(8)}{c()}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{c()}{d(7)}", f"{c()}{d(8)}", f"{c(2)}{d(7)}", f"{c()}{d(2)}{c()}{d(4)}{c()}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c()}", f"{c(2)}{d(6)}{c()}", f"{d(6)}-{d(4)}", f"{d(4)}-{d(4)}-{d(2)}", f"{d(11)}", f"{d(9)}", f"{c(6)}{d(2)}{c()}{d(2)}{c()}{d(3)}{c()}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{c()}-{d(7)}", f"{c()}{d(2)}{c()}{d(2)}{c()}{d(2)}", f"{d(2)}/{d(3)}/{d(5)}"])

    def town(self) -> str:
        r = self.r
        return r.choice(["London", "Leeds", "Berlin", "Hamburg", "Lyon", "Nantes", "Madrid", "Sevilla", "Torino", "Utrecht", "Gdańsk", "Porto"]) if r.random() < 0.25 else (r.choice(["", "", "", "Bad ", "Saint-", "San ", "New "]) + self.invented())

    def address(self) -> str:
        r, d = self.r, self.d
        no = str(r.randrange(1, 300)) + r.choice(["", "", "", "", "a", "b", "c", "-" + str(r.randrange(2, 99)), " bis"])
        town, zipped = self.town(), d(5)
        uk = f"{r.choice('BCELMNSW')}{r.choice(['', 'S', 'W', 'X'])}{r.randrange(1, 29)} {r.randrange(1, 9)}{r.choice('ABDEHL')}{r.choice('ABDEHLT')}"
        road = f"{r.choice([self.invented(), self.word(), 'Park', 'Church', 'Mill', 'High', 'Station', 'Queen', 'Victoria', 'Green'])} {self.pick('road')}"
        german = r.choice([f"{self.invented()}{self.pick('strasse')}", f"{r.choice(['Hof', 'Markt', 'Dom', 'Post', 'Wald', 'See', 'Rosen', 'Birken', 'Berg', 'Mühl'])}{self.pick('strasse')}", f"{r.choice(['Hinter', 'Vor', 'Bei', 'Zwischen'])} {r.choice(['dem', 'den', 'der'])} {r.choice(['Höfen', 'Gärten', 'Mauer', 'Toren', self.invented()])}", f"{r.choice(['Am', 'An der', 'Im', 'Auf der'])} {self.invented()}", f"{self.invented()}er {r.choice(['Straße', 'Str.', 'Weg', 'Allee', 'Platz'])}", f"{r.choice(['Haupt', 'Bahnhof', 'Garten', 'Kirch', 'Linden', 'Schul', 'Berg'])}{self.pick('strasse')}"])
        tail = r.choice([f"{zipped} {town}", f"D-{zipped} {town}", f"{d(4)} {town}", f"{d(4)} {r.choice('ABCDX')}{r.choice('ABCDX')} {town}", town])
        french = f"{no}{r.choice([',', '', ''])} {self.pick('rue')} {r.choice([self.invented(), 'Fleurs', 'Moulin', 'Gare', 'Victor Hugo'])}"
        spanish = f"{self.pick('calle')} {r.choice([self.invented(), 'Mayor', 'del Prado', 'Roma', 'San ' + self.first()])} {no}"
        flat = r.choice([f"Apt {d(1)}", f"Apt. {d(2)}", f"Flat {d(1)}", f"Unit {d(2)}", f"Suite {d(3)}"])
        return r.choice([
            f"{no} {road}, {town}", f"{no} {road}, {town} {uk}", f"{no} {road}, {town}, {uk}", f"{no} {road}, {flat}, {town}", f"{flat}, {no} {road}, {town}", f"{no} {road}, {town}, {r.choice(['NY', 'TX', 'CA', 'OH'])} {zipped}", f"{german} {no}, {tail}", f"{german} {no}, {tail}", f"{german} {no}, {tail}", f"{german} {no}/{d(1)}, {tail}",
            f"{no} {road}, {town}", f"{no} {road}, {town} {uk}", f"{no} {road}, {town}", f"{no} {road}, {town}", f"{french}, {zipped} {town}", f"{french}, {zipped} {town}", f"{french}, {zipped} {town}", f"{french}, {town}", f"{spanish}, {zipped} {town}", f"{spanish}, {d(1)}º {r.choice('ABC')}, {zipped} {town}", f"{spanish}, {town}", f"{r.choice(['P.O. Box', 'PO Box', 'Postfach', 'BP', 'Apartado'])} {d(r.choice((2, 3, 4)))}, {r.choice([town, f'{zipped} {town}'])}",
        ])

    def org(self) -> str:
        r = self.r
        base = r.choice([f"{self.word()} {self.pick('trade')}", f"{self.word()} {self.word()} {self.pick('trade')}", f"{self.word()} & {self.word()} {self.pick('trade')}", f"{self.invented()} {self.pick('trade')}", f"{self.word()} {self.word()}"])
        return f"{base} {self.pick('legal')}" if r.random() < 0.3 or base.count(" ") < 2 and r.random() < 0.3 else base

    def date(self) -> str:
        r = self.r
        y, mo, d = r.randrange(1980, 2027), r.randrange(1, 13), r.randrange(1, 29)
        return r.choice([f"{y}-{mo:02}-{d:02}", f"{y}-{mo:02}-{d:02}", f"{y}-{mo:02}", f"{mo:02}-{y}", f"{mo:02}/{y}", f"{mo}/{y}", f"{d:02}.{mo:02}.{y}", f"{mo}.{y}", f"{d} {self.pick('m')} {y}", f"{self.pick('m')} {y}", f"{self.pick('m')} {y}", f"{self.pick('m').upper()} {y}", f"{self.pick('m')} {y % 100:02}", f"{y}", f"{y}", "present", "today", "heute", "now", "unknown", "aujourd'hui", "actualidad"])

    def skill(self) -> str:
        r = self.r
        if r.random() < 0.45:
            return self.pick("k")
        out = f"{r.choice(_SKILL[0])} {r.choice(_SKILL[1])}"
        return out if r.random() < 0.5 else out.lower() if r.random() < 0.5 else out.capitalize()

    def school(self) -> str:
        r = self.r
        return r.choice([f"{self.word()} University", f"University of {self.town()}", f"{self.word()} College", f"{self.word()} {self.word()} Academy", f"Universität {self.town()}", f"Université de {self.town()}", f"{self.word()} Institute of Technology", f"{self.town()} School of Business"])

    def contact(self) -> str:
        if self.r.random() < 0.08:
            return f"[name:{self.name()}]"
        own = {"email": f"{self.pick('el')}[email:{self.email()}]", "phone": f"{self.pick('pl')}[phone:{self.phone()}]", "address": f"{self.pick('al')}[address:{self.address()}]", "id": f"{self.pick('il')}{self.r.choice([' ', ': ', ' : '])}[id_number:{self.number()}]"}
        return self.r.choice([*own.values(), own["address"]])

    def fill(self, line: str) -> str:
        r = self.r
        made = {"n": self.name, "e": self.email, "p": self.phone, "i": self.number, "a": self.address, "c": self.contact, "w": self.word, "org": self.org, "school": self.school, "town": self.town, "dt": self.date, "k": self.skill}

        def slot(m) -> str:
            k = m[1]
            if k in made:
                return made[k]()
            if k == "y":
                return str(r.randrange(1975, 2027))
            if k == "acr":
                return "".join(r.choice("ABCDEFGHJKLMNPRSTVWXZ") for _ in range(r.randrange(3, 6)))
            if k == "H":
                return self.pick("h").upper()
            if k[0] == "d" and k[1:].isdigit():
                n = int(k[1:])
                return str(r.randrange(10 ** (n - 1), 10**n))
            out = self.pick(k)
            return out if k != "k" or r.random() < 0.8 else r.choice([out.upper(), out.lower(), out.capitalize()])

        return regex.sub(r"\{(\w+)\}", slot, line)

    def contacts(self) -> str:
        sep, n = self.pick("sep"), self.r.choice((1, 1, 2, 2, 3, 4))
        return sep.join(self.contact() for _ in range(n))

    def rows(self, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
        """(text, items) of ``n`` lines."""
        r, out = self.r, []
        share = [(None, 0.23), (OWN, 0.12), (OTHERS, 0.27), (PLAIN, 0.38)]
        for lines, part in share:
            for i in range(int(n * part)):
                marked = self.contacts() if lines is None else self.fill(lines[i % len(lines)])
                text, spans = unmark(marked)
                if r.random() < 0.06:  # noise of scanned pages
                    text = "".join(_NOISE.get(c, c) if r.random() < 0.08 else c for c in text)
                out.append((text, spans))
        return out


# Single characters as scanning misreads them; equal lengths keep the marks in place.
_NOISE = {"t": "†", "a": "@", "o": "0", "l": "1", "i": "í", "e": "c", "h": "b", "s": "5"}


def unmark(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of a marked-up line and its items as (begin, end, type)."""
    text, spans, last = "", [], 0
    for m in regex.finditer(r"\[(email|phone|id_number|address|name):((?:[^\[\]]|\[at\])*)\]", marked):
        text += marked[last : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        last = m.end()
    return text + marked[last:], spans
