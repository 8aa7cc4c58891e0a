"""Hand-written lines with marked items, apart from the labelled table of the model. ``SEEN`` was looked at while the table
was widened. ``LATER`` was written then and tried three times while the last variants were compared. ``UNSEEN`` was
written when the model was done, and tried once."""

SEEN = """
[name:Samantha O'Neill]
[name:Friedrich Baumgartner]
[name:Thi Minh Nguyen]
[name:MARGARET THORNBURY]
[name:Jean-Baptiste Carpentier]
[name:María del Carmen Ortega]
[name:Kowalczyk, Agnieszka]
[name:D. Featherstone]
[name:Aleksandr Voronin]
[name:Mehmet Özdemir]
[name:Lieke van den Broek]
[name:Björn Lindqvist]
[name:Siobhan Gallagher-Byrne]
[name:Chidi Okonkwo]
[name:Ilse Brandstätter]
Curriculum vitae – [name:Henrik Aaltonen]
Personal details: [name:Rebecca Stone]
Surname, first name: [name:Hollis, Patricia]
CV [name:Tomasz Zieliński]
Application of [name:Odette Marchetti], page 2
Bewerbungsmappe von [name:Uwe Kessler]
Candidature de [name:Solène Picard]
[name:Nikolaos Papadakis] | 3
Mr. [name:Geoffrey Palmer]
Frau [name:Annegret Sommer]
Dr. [name:Lukas Steinbach], head physician
[email:m.thornbury@uzh.ch] is no longer used, write to [email:margaret.thornbury@proton.me]
[email:k.voss@web.de]
[email:SALLY.WHITTAKER@BTINTERNET.COM]
[email:jo_anders77@yahoo.co.uk]
E-Mail: [email:c.delacroix@orange.fr]
email [email:tanaka.hiro@keio.ac.jp]
[email:r.montoya+bewerbung@gmx.net]
Courriel: [email:lea-marie.fabre@laposte.net]
Mail [email:p-hofer@tirol.at] or phone [phone:+43 512 334455]
[email:dimitra (at) forthnet (dot) gr]
[email:novak.petr [at] seznam.cz]
[email:paul AT fischer DOT io]
[email:admin@bakery-miller.com]
[phone:+44 7700 900123]
[phone:+49 171 5550199]
[phone:(212) 555-0147]
[phone:0151/23456789]
[phone:01 45 67 89 10]
[phone:612 34 56 78]
Tel. [phone:030 901820]
Phone [phone:+1-416-555-0182]
Mobile: [phone:07911 123456]
Tél. [phone:+33 6 12 34 56 78]
Teléfono: [phone:+34 911 234 567]
Cell [phone:503.555.0134]
Home: [phone:020 7946 0958]
Fax [phone:+49 (0)89 123456-20]
Work phone [phone:555-0173, ext. 12]
Privat: [phone:0043 1 5869743]
[phone:+31 20 794 0837]
[phone:+48 601 234 567]
SSN [id_number:078-05-1120]
Passport no. [id_number:K1234567]
Passport: [id_number:C01X00T47]
National Insurance [id_number:QQ 12 34 56 C]
NI number [id_number:AB123456C]
Steuer-ID [id_number:65 929 970 489]
Steueridentnummer: [id_number:86095742719]
DNI [id_number:12345678-Z]
NIE: [id_number:X1234567L]
Personalausweis [id_number:L01X00T47]
ID card no. [id_number:T22000129]
Carte d'identité n° [id_number:880692310285]
Codice fiscale: [id_number:RSSMRA85T10A562S]
Personal identity number [id_number:811228-9874]
Sozialversicherungsnr. [id_number:15070649C103]
Social security number: [id_number:219-09-9999]
[address:42 Wallaby Way, Sydney]
[address:221b Baker Street, London NW1 6XE]
[address:10 Downing Street, London]
[address:1600 Pennsylvania Avenue, Washington, DC 20500]
[address:Kaiserstraße 12, 60311 Frankfurt]
[address:Unter den Linden 77, 10117 Berlin]
[address:Mozartgasse 4/12, 1040 Wien]
[address:15 rue de Rivoli, 75004 Paris]
[address:8, avenue Foch, 69006 Lyon]
[address:Calle de Alcalá 50, 28014 Madrid]
[address:C/ Serrano 21, 3º B, 28001 Madrid]
[address:Via Garibaldi 9, 16124 Genova]
[address:P.O. Box 1142, Bristol]
[address:Postfach 3401, 50667 Köln]
Address: [address:7 Orchard Lane, Flat 2, Norwich]
Anschrift: [address:Bergweg 3a, D-82467 Garmisch]
Adresse : [address:27 bis quai Voltaire, 75007 Paris]
Wohnort [address:Hohe Straße 118, 04107 Leipzig]
lives at [address:5 Kestrel Close, Exeter EX4 4QJ]
[email:h.lund@online.no] | [phone:+47 22 33 44 55]
[phone:+41 44 632 11 11]; [email:beat.zgraggen@bluewin.ch]
Address: [address:93 Long Acre, London WC2E 9RZ] | Tel. [phone:020 7123 4567]
[address:Schillerplatz 2, 70173 Stuttgart] · [phone:0711 2164980] · [email:stadt@archiv-stuttgart.de]
E-mail: [email:nora.quigley@eircom.ie]; Phone: [phone:+353 1 677 0095]
[phone:+39 06 6982], [email:ufficio.scavi@fsp.va]
Passport no. [id_number:533380006] | [email:alex_mason@aol.com]
DNI [id_number:87654321X]; Tel. [phone:93 402 70 00]
[name:Peter Sandoval] | [email:psandoval@unm.edu] | [phone:(505) 277-0111]
[name:Grete Wolff], [address:Amselweg 19, 33602 Bielefeld]
My boss at the time, [name:Laurence Whitcombe], can confirm this.
I was promoted by Mr. [name:Desmond Achebe] after the flood.
The shop was later run by [name:Rosalind Meakin].
For verification ring Mrs [name:Philippa Crane], [phone:01632 960001].
[name:Arturo Benedetti] taught me to weld.
Please ask Ms [name:Ottilie Frank] for the signed copy.
Certificate signed by Prof. [name:Emeka Nwosu]
approved by [name:Samantha O'Neill]
Kontakt: [name:Friedrich Baumgartner], [address:Kaiserstraße 12, 60311 Frankfurt]
Ersatz für [name:Hannelore Pfeiffer] während der Elternzeit
Mein Meister, Herr [name:Alois Gruber], stellte das Zeugnis aus.
Zeugnis von Frau [name:Dagmar Seidel] liegt bei.
Auskunft erteilt [name:Renate Hoppe], [phone:0221 4710815].
Absender: [name:Kilian Moser], [address:Dorfplatz 1, 6370 Kitzbühel]
Ma supérieure, Mme [name:Bénédicte Lacroix], peut en témoigner.
Lettre signée par M. [name:Gaspard Delorme]
Stage encadré par [name:Hélène Vasseur]
Pour tout renseignement : [email:rh@ateliers-lumiere.fr]
Mi supervisor, el Sr. [name:Joaquín Valverde], se jubiló en 2017.
Carta firmada por la Sra. [name:Amparo Cifuentes]
Contactar con [name:Begoña Iturralde] en el [phone:944 24 57 00]
Il direttore, Dott. [name:Ettore Marangoni], ha firmato.
Mijn baas was de heer [name:Sjoerd Hoekstra].
Emergency: [name:Dolores Whelan], sister, [phone:+353 87 123 4567]
Reference: Dr. [name:Yvonne Abara], [email:y.abara@stmaryhospital.org]
References on request from [name:Callum Reid] and [name:Isla Drummond].
Send mail to [email:office@harbour-trust.org] please.
Write to [address:18 Sea View Terrace, Whitby YO21 3PT] if I am away.
Letters reach me at [address:Rosenweg 7, 8001 Zürich].
Covered for [name:Bartholomew Quinn], my predecessor.
Interviewed by [name:Svetlana Orlova] on the radio
Shared a desk with [name:Kwame Mensah].
Call [phone:+1 604 555 0144] between 9 and 5.
My identity card is [id_number:DE4427819], issued in Bonn.
The work visa under passport [id_number:N8421907] expires in 2027.
Professional Experience
Madrid Barcelona
Education and Training
WORK EXPERIENCE
Other Skills
Weitere Kenntnisse
Expériences
Referenzen
Beyond Work
Volunteer Work
Career Goals
Language Skills:
Personal Interests
Selected Publications
Senior Software Engineer
Registered Nurse, Intensive Care
Pastry Chef and Baker
Assistant Store Manager
Bauleiter Hochbau
Chargé de clientèle
Deutsche Bahn AG | Train Driver | 2011 – 2016
Barclays Bank plc, Leeds | Teller | Mar 2008 – Jun 2012
Ramirez & Sons Plumbing | Apprentice | 1999 – 2002
Novartis | Lab Assistant | 05/2014 – today
Marriott Hotels – Night Auditor (June 2015 – May 2018)
2009–2013 Siemens Energy, Erlangen
Harlow Logistics Ltd | Dispatcher, Essex | 2019-03 – present
Bright Minds Academy, Oslo
University of Edinburgh, 2004
BSc Physics, Trinity College Dublin
Managed the weekly delivery plan for nine branches.
• Negotiated leases for two new warehouses
- Introduced barcode scanners and saved 14% of picking time
Prepared quarterly tax returns under time pressure.
Cared for up to twelve residents on night duty
together with the sales department. Wrote
customers and suppliers in three countries.
participating schools
of the regional council
which was later adopted by the whole group.
Python, Django, PostgreSQL, Redis
Project Management; Budgeting; Hiring
Excel | PowerPoint | Outlook
Skills: Typing, Filing, Phone Manners
Tools: Jira, Figma, Adobe Photoshop
Kenntnisse: Schweißen, Drehen, Fräsen
Compétences : cuisine, pâtisserie, service
Sign Language and First Aid
Event Lighting • Stage Rigging • Sound Mixing
Quality Management / Lean Production
"Deep Learning", "Data Mining"
Fluent in English and French, basic Dutch
Languages: Polish (native), German (B2)
Revenue grew from 1,200,000 to 1,450,000 euros.
Handled 3500 tickets in 2022, 98 percent on time.
Invoice 2023-00417 over EUR 1.250,00
Serial no. 44-1209-7 replaced under warranty
Release 4.12.0-3391 shipped in May.
ISO 9001:2015 and ISO 14001:2015 audits passed
Order 55-10293 was delayed by 6 weeks.
Open Mon-Fri 08:00-18:00, Sat 09:00-13:00
Map square 5521-9904, plot 17
Tolerance 0.05 mm at 1200-1500 rpm
between 12.03.2018 and 31.12.2019
March 2015 – April 2017
Page 3 of 7
Seite 2
Confidential personnel file
Member of the Sheffield Hiking Club since 2010.
Winner of the Nordic Design Award 2014
Moved to Rotterdam in 2006 and to Ghent in 2011.
Shops in Graz, Linz and Salzburg
Set thermostat@2.1 to eco mode
Tagged @night_crew and @dispatch in the channel
Sold tickets at 3@20 on market days
Founded the Green Valley Cooperative in 2001.
Customer: Hansen Shipping, Bergen
Project Aurora, phase 2
Attached: two certificates
Willing to travel to Dublin or Cork
Driving licence since 1998
Available at once
Grade 1.7, best of the year
Team of 14 in building C, room 208
Budget 2021/22: 340,000 USD
Lot 77/2048 rejected, lot 77/2049 passed
""".strip("\n").split("\n")

LATER = """
[name:Bronwen Pritchard]
[name:Giorgos Stathakis]
[name:AMINATA DIALLO]
[name:Leif Torvaldsen]
[name:Hendrikje de Graaf]
[name:Zsófia Balogh]
[name:R. Whitlock]
[name:Iglesias, Rodrigo]
Profile of [name:Malcolm Dray]
Bewerber: [name:Wolfram Ziegler]
Personal data sheet – [name:Noémie Charpentier]
[email:bronwen.p@cymru.net]
[email:g_stathakis@otenet.gr]
Email: [email:a.diallo-ba@ucad.sn]
[email:leif (at) fjordmail (dot) no]
[phone:+47 481 22 907]
[phone:(617) 555-0128]
Telefon: [phone:0621 4017-55]
Tel [phone:+39 340 123 4567]
Mobile [phone:+44 (0)7700 900456]
Passport number [id_number:GB7720184]
Ausweisnr. [id_number:L8M4T2X09]
NIF [id_number:45872219-K]
SSN: [id_number:402-71-3388]
Tax ID [id_number:47 036 892 816]
[address:61 Thornbury Road, Cardiff CF10 3NB]
[address:Gartenstraße 88, 79098 Freiburg]
[address:3 rue du Faubourg, 67000 Strasbourg]
[address:Avenida de América 14, 2º A, 28002 Madrid]
[address:P.O. Box 77, Galway]
[address:Am Stadtgraben 5, 48143 Münster]
[address:29 Willow Crescent, Apt 12, Toronto]
Address: [address:4 Abbey Close, Bath] | [phone:01225 496000] | [email:dray.m@bathmail.org.uk]
[phone:+36 30 555 8812] · [email:zs.balogh@freemail.hu] · [address:Kossuth utca 12, 6720 Szeged]
[name:Rowena Ashdown] – [email:r.ashdown@northlight.org]
The depot was taken over by [name:Cormac Delaney] in 2018.
Ms [name:Ingeborg Thalberg] signed the final report.
You can verify this with Dr. [name:Anselm Krüger], [phone:0351 4960-112].
Worked closely with [name:Paloma Reyes] on the new timetable.
In my absence [name:Jerome Baptiste] ran the kitchen.
Zeugnis ausgestellt von Herrn [name:Eckhart Lindemann]
Fragen beantwortet Frau [name:Swantje Behrens], [email:s.behrens@hafen-nord.de].
Zuständig war [name:Konstantin Weiß].
Madame [name:Odile Renaudin] a relu le dossier.
Recommandation de M. [name:Thierry Gauthier], [phone:04 72 41 88 20]
Avalado por la Sra. [name:Pilar Echeverría]
Preguntar por [name:Ramiro Quintana] en recepción.
Notify in an accident: [name:Edda Nyström], [phone:+46 70 174 0611]
Post to [address:12 Foundry Lane, Derby DE1 2RH] only.
Since June my flat is [address:Seestraße 31, 8002 Zürich].
Reply to [email:jobs@millrace-bakery.co.uk] by Friday.
Visa granted on passport [id_number:P4419027].
Practical Experience
Additional Training
Schulische Laufbahn
Parcours professionnel
Datos de interés
Hobbies and Sport
Night Shift Supervisor
Civil Engineer (temp)
Kaufmännische Angestellte
Tesco Stores Ltd | Cashier | 2014 – 2016
Voss & Partner Architekten | Bauzeichner | 03/2009 – 11/2012
Oakfield Primary School, Teaching Assistant, 2017-09 – 2019-07
Renault SA | Mécanicien | janvier 2001 – mai 2006
MSc Marine Biology, University of Bergen
Rebuilt the spare parts catalogue within four months.
• Supervised eleven trainees and two apprentices
Answered phone calls and sorted the mail
for the regional hospital board. Improved
visitors from abroad
Photoshop, Illustrator, InDesign
Spreadsheet Modelling; Cost Control; Forecasting
Tools: Trello, Slack, Notion
Kenntnisse: Buchführung, Lohnabrechnung, DATEV
Greenhouse Care | Pruning | Irrigation
Swedish (native), English (C1), Finnish (A2)
Sales rose by 12,500 to 61,200 units.
Article 4410-88 is out of stock until 05/2024.
Build 7.3.1-2206 fixed 41 bugs.
DIN 18560-2 and DIN EN 13813 observed
Shift 22:00-06:00, 5 days a week
01.04.2011 – 30.09.2013
Page 4 of 9
Member of the Tromsø Sailing Club, 2003–2009
Branches in Lille, Ghent and Aachen
Project Halcyon: new signal boxes
Own car, licence class B
Enclosures: three references
Rotated @morning_team through pump@4.2
Prize of the Ravenna Foundation, 2016
""".strip("\n").split("\n")
UNSEEN = """
[name:Ottoline Fairbairn]
[name:Casimir Brzezinski]
[name:JOAQUIN ESTRADA]
[name:Wilhelmina ter Horst]
[name:N. Achterberg]
[name:Tsukamoto, Haruki]
CV – [name:Roisin Mulcahy]
Lebenslauf von [name:Dietmar Hasselbach]
[name:Ewa Szymborska], bookkeeper
[email:ottoline@fairbairn.org.uk]
E-mail: [email:c.brzezinski@poczta.onet.pl]
[email:jestrada_88@correo.mx]
Contact: [email:w.terhorst (at) ziggo.nl]
[phone:+52 55 1234 5678]
Tel.: [phone:+48 22 583 10 07]
Mobile [phone:087 212 3498]
[phone:(415) 555-0199]
Telefon [phone:0341/9612-340]
Passport no. [id_number:M7730921]
Personalausweis: [id_number:T01000322]
DNI [id_number:71245603-H]
SSN [id_number:531-08-2276]
[address:14 Hawthorn Avenue, Limerick]
[address:Bahnhofstraße 20, 8001 Zürich]
[address:22 rue Lafayette, 31000 Toulouse]
[address:Calle Toledo 7, 1º C, 28005 Madrid]
[address:P.O. Box 509, Cork]
[address:77 Maple Drive, Apt 4, Boulder]
[address:Gerberweg 3, 72070 Tübingen] | [phone:07071 55 81 20]
[email:roisin@mulcahy.ie]; [phone:+353 61 440 012]; [address:9 Quay Terrace, Ennis]
The rota was drawn up by [name:Finbar Costello].
Mrs [name:Lavinia Prescott] can be asked about the audit.
My apprenticeship ended under [name:Rainer Obermeier].
Kindly write to [email:hr@stonebridge-mills.com].
Nachgewiesen durch Herrn [name:Volker Tannhäuser], [phone:0761 20400]
Frau [name:Mechthild Lorenzen] bestätigte die Angaben.
Tutrice : Mme [name:Clémence Aubry]
Mi tutor fue [name:Nicanor Villegas], [email:n.villegas@uned.es]
[name:Sibylle Escher] and [name:Arno Lüthi] ran the second shift.
If needed, phone [name:Declan Roche] at [phone:+353 86 555 0171].
Rooms were rented at [address:Marktplatz 6, 35037 Marburg].
Technical Competencies
Clubs and Societies
Berufliche Stationen
Formations
Dental Technician
Chief Purchasing Officer
Lidl Stiftung | Filialleiter | 2012 – 2017
Hughes & Daughters Bakery, Cork | Baker | Apr 2003 – Sep 2009
Technical University of Denmark, 1998
Repaired and tested hydraulic presses.
• Drew up duty plans for thirty drivers
for two neighbouring parishes.
Weaving, Dyeing, Spinning
Tools: Excel, Access, Lotus Notes
Beekeeping | Fruit Growing | Pruning
Russian (fluent), Greek (A1)
Costs fell from 88,000 to 61,500 pounds.
Part no. 7712-04-B, revision 3
Software release 11.4.2 of 2019-06-30
Open 09:30-17:00 except Mondays
15.02.2007 – 30.06.2010
Sheet 2 of 5
Trips to Bergamo, Verona and Trento
Member of the Galway Sailing Club
""".strip("\n").split("\n")
