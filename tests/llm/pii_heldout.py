"""Rows written by hand to measure the personal-information field on wording, names and numbers it wasn't trained on.

A value stands as <kind|value>; kinds are n (name), e (email), p (phone), i (id number), a (street address).
"""

ROWS = r"""
<n|John Smith> is on the phone, he says.
The keynote goes to <n|Angela Merkel> this time.
We owe this result to <n|Priya Raman> and <n|Kofi Mensah>.
<n|Barbara Liskov> explained the proof again.
Reviewer two was <n|Tomasz Zieliński>, apparently.
I asked <n|Sarah Connor> whether the gate was shut.
Ms. <n|Deborah Quayle> cannot attend.
Mr <n|Fred Astor> tipped the waiter.
Dr. <n|Nadia Benali> operates on Tuesdays.
Professor <n|Gustav Lindholm> disagreed.
Prof. <n|H. Lindholm> disagreed as well.
My landlord, <n|Patrick O'Hara>, never calls back.
The winner: <n|Jesús Alonso Prieto>!
Kind regards
<n|Monica Gellar>
Best,
<n|Ted Moseby>
Yours faithfully,
<n|R. J. Whitfield>
The defendant <n|Walter Kessler> denied everything.
Payment was approved by <n|Kessler, Walter> on the same day.
Invite <n|Sunita Rao>, <n|Ben Ashworth> and <n|Lena Vogt> to the call.
Paintings by <n|Artemisia Lomi> hang in the hall.
Her teacher <n|Miguel Ángel Robles> wrote a reference.
Captain <n|Elif Kaya> took over at dawn.
Tickets are under the name <n|Bjarne Stroustrup>.
Our vet is <n|Dolores Huerta>; she is kind.
<n|Rosalind Franklin> took the photograph.
Did <n|Oscar Niemeyer> design this one?
The proposal of <n|Katalin Karikó> was turned down.
Signed <n|Imre Kertész>
Witness: <n|Aleksandra Mazur>
Mother's name <n|Henrietta Lacks>
Le directeur, <n|Mathieu Garnier>, partira en juillet.
Madame <n|Sylvie Perrault> a gagné le prix.
Demandez à <n|Yannick Le Goff> de fermer la porte.
La chanson est d'<n|Édith Gassion>.
Merci encore à <n|Benoît Mandel> pour son aide.
<n|Florence Aubenas> raconte son voyage.
Monsieur <n|J. Delacroix> vous attend.
Unser Hausmeister heißt <n|Jürgen Tischler>.
Herr <n|Manfred Krug> spielt heute nicht.
Frau <n|Ursula Brandt> nimmt das Protokoll auf.
Die Rede hielt <n|Heinrich Böttcher>.
<n|Sabine Kretschmer> hat gekündigt.
Der Trainer <n|Uwe Seelmann> bleibt.
Gruß, <n|Ilse Aigner>
La profesora <n|Rosario Castellanos> publicó otro libro.
El señor <n|Joaquín Sabater> pidió la cuenta.
<n|Isabel Coixet> dirigió la película.
Saludos, <n|Álvaro Pombo>
Mi vecina <n|Consuelo Berges> toca el piano.
O autor, <n|Valter Mãe>, vive no Porto.
A senhora <n|Adelaide Cabete> abriu a sessão.
<n|Gonçalo Tavares> ganhou o concurso.
Abraço, <n|Mariana Alcoforado>
O treinador <n|Nuno Espírito> pediu desculpa.
STAFF: <n|LINDA HAMILTON>
contact person <n|Gwen Stacy>, <p|+44 113 496 0421>
For bookings dial <p|01632 960983> now.
You will find us under <p|+49 221 5558 3120>.
The number to remember is <p|(212) 555-0143>.
Emergency desk <p|+1 415 555 0132>
mobile <p|07700 900461>, landline <p|0161 496 0734>
Just buzz <p|555-867-5309> and hang up.
Our fax machine <p|+33 4 91 57 01 88> is out of paper.
Le secrétariat répond au <p|04 65 71 23 90>.
Numéro vert : <p|0805 98 76 54>
Sonnez ou faites le <p|+32 2 555 12 12>.
Die Zentrale hat die <p|030 901820>.
Melden Sie sich unter <p|0211/6355-120>.
Notruf der Werkstatt: <p|+43 1 5880034>
Apunta mi teléfono: <p|+34 612 34 56 78>
Recepción <p|91 540 18 22>
Consultas al <p|+54 11 4382-5566>.
O número da receção é <p|+351 213 456 789>.
Ligue já <p|800 200 133>
Contacte-nos: <p|+55 11 98765-4321>
Helpline <p|1-800-555-0199 ext. 42> for members
Text STOP or ring <p|+44 (0)20 7946 0018>.
tel <p|020-7946-0991>
dial <p|0117 496 0112 x204> and wait
night line: <p|+1 (646) 555-0178>
Both lines, <p|0131 496 0555> and <p|0131 496 0556>, are dead.
The plumber gave me <p|+48 22 555 01 09>.
kantoor <p|+31 20 555 0147>
Cell. <p|+39 06 5550 1234>
Reception desk <p|+61 2 5550 7384>
Room service <p|(03) 9555 0199>
Please direct enquiries to <e|press.office@bluewhale.org>.
Drop me a line: <e|j.ashworth@northwind.co.uk>
The bot answers at <e|noreply@shopfront.io>.
Whoever wants in should ping <e|lena.vogt+club@posteo.de>.
user <e|gwen_stacy@mail.dailybugle.com> was removed
Unsubscribe via <e|list-leave@gardeners.net>.
Old address <e|BOB77@COMPU.EXAMPLE> bounced.
my address is <e|ted (at) mosby (dot) com>
<e|fax2mail@bureau.fr> reçoit les télécopies.
Adressez le manuscrit à <e|redaction@editions-vega.fr>.
Écris-moi : <e|sylvie.p@orange.example>
Bewerbungen bitte per Mail: <e|karriere@maschinenbau-otto.de>
Mehr Infos gibt es bei <e|info@stadtbad.at>.
Die Rechnung ging an <e|u.brandt[at]kanzlei.test>.
Mándalo a <e|pedidos@lalibreria.es> hoy mismo.
Quejas: <e|defensor.cliente@banco.example>
Inscrições em <e|cursos@escola-mar.pt>.
Escreve-me: <e|goncalo99@correio.example>
login <e|root@backup.invalid>
sent from <e|kofi.mensah@uni-accra.edu> at noon
Speak to <e|helpdesk @ campus.edu> first.
the owner of <e|priya_r@tutamail.example> has not replied
From: <e|calendar-bot@sync.net>
account <e|x.ae12@rocket.example> suspended
or via <e|ombuds@city.gov>, whichever is quicker
Holder of passport <i|L8988901C> must report.
Passport no <i|533380006> was stolen.
My social is <i|078-05-1120>, keep it quiet.
SSN <i|219 09 9999>
NINO <i|QQ 12 34 56 C> is printed on the payslip.
Use IBAN <i|GB82 WEST 1234 5698 7654 32> for the deposit.
Refunds go to <i|DE89370400440532013000> only.
IBAN: <i|FR14 2004 1010 0505 0001 3M02 606>
Pay into account <i|NL91 ABNA 0417 1643 00>.
Her tax identifier is <i|47 036 892 816>.
Steuer-ID <i|86095742719>
Personalausweis <i|T220001293> ungültig
Reisepass <i|C01X00T47> abgelaufen
Numéro de sécu : <i|1 85 05 78 006 084 36>
Passeport <i|12AB34567> périmé
Carte nationale d'identité <i|880692310285>
DNI <i|12345678Z>
con DNI <i|12.345.678-Z> y domicilio conocido
NIE <i|X1234567L>
Cuenta <i|ES91 2100 0418 4502 0005 1332>
Pasaporte <i|AAA123456> extraviado
NIF <i|123 456 789>
Passaporte <i|N123456> perdido
IBAN <i|PT50000201231234567890154>
Cartão de cidadão <i|00000000 0 ZZ4>
personnummer <i|811228-9874>
the claimant's national insurance number, <i|AB123456D>, was wrong
Tax file <i|123-456-782>
bank account <i|BE68 5390 0754 7034> is closed
Id card <i|AX1234567> confiscated
Drop the parcel at <a|12 Elm Street, Springfield 01103>.
They bought <a|221B Baker Street> in 1934.
Shop: <a|48 Fleet Lane, Leeds LS1 4BR>
The notary sits at <a|7 Harbour Road, Unit 4>.
Send cheques to <a|1600 Amphitheatre Parkway, Mountain View 94043>.
venue: <a|5 Abbey Court>
My aunt's house, <a|33 Willow Crescent, Bath BA2 3EF>, is for sale.
<a|Flat 3, 19 Percy Road, Hull HU5 2QR> needs a new boiler.
Service address: <a|900 Grand Avenue, Apt 12>
We live at <a|64 Orchard Close
Exeter EX4 1AB> these days.
Le cabinet est situé <a|8, rue des Lilas, 75020 Paris>.
Passez nous voir <a|15 avenue Foch>.
Livraison : <a|22 bis, boulevard Carnot, 59800 Lille>
Adresse du siège <a|3, place Bellecour
69002 Lyon>
Sa maison, <a|41 chemin des Vignes>, a brûlé.
Der Laden in der <a|Goethestraße 17, 60313 Frankfurt> schließt.
Praxis: <a|Lindenweg 4>
Abzugeben bei <a|Marktplatz 1, 8010 Graz>
Er zog in den <a|Ahornweg 22 b>.
Werkstatt <a|Hauptstr. 101
50667 Köln>
Am Ende der Straße: <a|Kastanienallee 86>
La tienda está en <a|Calle Mayor 21, 28013 Madrid>.
Quedamos en <a|Plaza de España, 4>.
Recogida: <a|Avda. Diagonal, 405, 08008 Barcelona>
Vive en <a|C/ Alcalá, 50, 3.º B>.
Paquete para <a|Paseo de Gracia, 92>
A loja fica na <a|Rua Augusta, 120, 1100-053 Lisboa>.
Morada fiscal: <a|Av. da Boavista 837, 2.º Esq.>
Mora na <a|Travessa das Flores, n.º 9>.
Recolha: <a|Praça da Alegria, 16, 4000-033 Porto>
Vivemos na <a|Rua do Carmo 31>.
The train to Manchester leaves at 10:42 from platform 13.
In Buenos Aires, winter starts in June.
On 14 March 2021 the river rose 3.2 m.
Order 5541 contains 12 boxes of Green Tea and one Blue Lamp.
Great Western Railway cut 40 jobs.
Version 12.4.1 of the driver needs 512 MB.
The Mona Lisa is smaller than people expect.
Protein P53 binds at 37 °C within 90 minutes.
Follow @spacecat for photos of Jupiter.
Lot 20231107-B failed inspection.
Der Zug nach Hamburg fährt um 8:15 Uhr.
Die Bundesbank sitzt in Frankfurt am Main.
Le musée du Louvre ouvre à 9 h 30.
El Museo del Prado cierra los lunes.
A Torre de Belém foi construída em 1519.
The price rose from $1,299.00 to $1,450.00.
See pages 112-134 of the Annual Report.
North Sea oil output fell 4.5 % in 2019.
Sample 88-1402-3 was kept at -80 °C.
Every Friday Night Market stalls open late.
Temperature readings: 12.5, 13.1, 12.9 and 14.0.
World Health Organization guidelines changed again.
Bus 42 stops at Victoria Square.
Chapter 7 covers 250 years of Ottoman rule.
Die Auflage betrug 12 500 Stück.
Le vol AF1234 est retardé.
La temperatura bajó a 3 grados en Sierra Nevada.
O comboio 520 para Coimbra está atrasado.
We counted 10 442 birds near Lake Geneva.
Error 0x80070057 occurred at line 2214.
"""

NAMES = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "a": "street_address"}


def rows() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of each row; a line that opens no row of its own (a foot or the second line of an address) joins the one before."""
    import re

    joined: list[str] = []
    for line in ROWS.strip().split("\n"):
        if joined and (joined[-1].count("<") > joined[-1].count(">") or joined[-1] in ("Kind regards", "Best,", "Yours faithfully,")):
            joined[-1] += "\n" + line
        else:
            joined.append(line)
    out = []
    for raw in joined:
        text, spans, at = "", [], 0
        for m in re.finditer(r"<([nepia])\|([^>]*)>", raw):
            text += raw[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), NAMES[m[1]]))
            text, at = text + m[2], m.end()
        out.append((text + raw[at:], spans))
    return out
