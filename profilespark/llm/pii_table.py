"""The labelled table that the personal-information field is trained on, made from wording and value forms.

``labelled_rows`` gives (text, [(start, end, kind)]). The wording was written for this module from general knowledge of
letters, notices and forms in five languages, and the value forms from public numbering plans and document formats; none
of it is taken from the documents that are searched (a test holds the two against each other). Names come from three
sources, so that list, parts and context are all learnt: the name list given, heads and tails of its names put together
anew, and names of many countries that the list doesn't have. Places are made from syllables.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LANGS = ("en", "fr", "de", "es", "pt")

# Wording around a value, by kind and language: what stands before it, what may follow (fixed values).
AROUND: dict[str, dict[str, tuple[str, str]]] = {
    "email": {
        "en": ("please send comments to|you can email|forward the invoice to|his address is|reply directly to|for access, mail|cc|e-mail|email:|Contact:|my mail is|(mail|copy it to|subscribe at|mailto:|<", "by Friday|if anything is unclear|and attach the file|for details|with the subject line Order| instead|, thanks|)|>"),
        "fr": ("merci d'envoyer vos remarques à|vous pouvez joindre|courriel :|mél :|adresse électronique|transmettez le devis à|répondez à|Contact :|une copie à", "avant vendredi|en cas de doute|pour plus de détails| svp|, merci"),
        "de": ("bitte senden Sie die Unterlagen an|Rückfragen beantwortet|E-Mail:|Mail an|schicken Sie das Formular an|meine Adresse lautet|Kontakt:|antworten Sie an|anmelden unter", "bis Freitag|bei Unklarheiten|, danke| erreichbar"),
        "es": ("envíe sus comentarios a|puede escribir a|correo:|correo electrónico:|reenvíe la factura a|mi dirección es|Contacto:|responda a|copia para", "antes del viernes|si tiene dudas|, gracias| por favor"),
        "pt": ("envie os comentários para|pode escrever para|e-mail:|correio eletrónico:|encaminhe a fatura para|o meu endereço é|Contacto:|responda a|cópia para", "até sexta-feira|em caso de dúvida|, obrigado| por favor"),
    },
    "phone": {
        "en": ("for bookings dial|ring me on|her mobile is|my number is|Phone:|Tel.|Tel:|Fax:|telephone|text|call|(tel.|the hotline|switchboard|cell|WhatsApp|or by phone at|leave a message on", "after six|during office hours|and ask for the manager| for help|, please|if you get lost|)| does not answer"),
        "fr": ("composez le|mon portable est le|Tél. :|Tél :|Téléphone :|téléphonez au|Fax :|joignable au|le standard|appelez-moi au|ou par téléphone au", "après dix-huit heures|aux heures de bureau|, merci|pour réserver| ne répond pas"),
        "de": ("erreichbar unter|meine Nummer ist|Tel.|Tel.:|Telefon:|Fax:|Mobil:|wählen Sie|rufen Sie uns an:|die Hotline|Handy|oder telefonisch unter", "nach achtzehn Uhr|während der Sprechzeiten|, bitte| ist nicht erreichbar"),
        "es": ("marque el|mi móvil es el|Tel.|Tel:|Teléfono:|llámeme al|Fax:|la centralita|o por teléfono al|WhatsApp", "después de las seis|en horario de oficina|, por favor|para reservar| no contesta"),
        "pt": ("marque o|o meu telemóvel é o|Tel.|Tel:|Telefone:|telefone-me para|Fax:|a central|ou pelo telefone|WhatsApp", "depois das seis|no horário de expediente|, por favor|para reservar| não responde"),
    },
    "id_number": {
        "en": ("her passport number is|passport|SSN|SSN:|social security no.|National Insurance number|NI number:|tax ID|tax id:|IBAN|IBAN:|account no.|bank account|ID no.|identity card|driving licence|insured under|transfer the rent to|Personal number:|number on the card:|record number|card|document no.", "was issued in June|expires next year|as proof of identity|before the end of the month|, see scan| is on file|and nothing else|has been blocked"),
        "fr": ("son passeport numéro|passeport|numéro de sécurité sociale :|NIR|numéro fiscal :|IBAN|IBAN :|compte bancaire|carte d'identité|pièce d'identité n°|versez le loyer sur|compte no|la carte|permis de conduire", "délivré en juin|expire bientôt|comme justificatif|avant la fin du mois| figure au dossier"),
        "de": ("ihr Reisepass trägt die Nummer|Reisepass|Personalausweis|Personalausweisnummer|Sozialversicherungsnummer|Steuer-ID:|Steuer-ID|Steuer-Nr.|IBAN|IBAN:|Kontonummer|Konto|überweisen Sie die Miete auf|Führerschein Nr.|Ausweis", "läuft bald ab|als Nachweis|bis Monatsende| liegt der Akte bei|wurde gesperrt"),
        "es": ("su pasaporte es el|pasaporte|DNI|DNI:|NIE|NIF:|número de la seguridad social|IBAN|IBAN:|cuenta bancaria|cuenta|ingrese el alquiler en|carné n.º|permiso de conducir|documento", "caduca pronto|como justificante|antes de fin de mes| consta en el expediente"),
        "pt": ("o passaporte dela é o|passaporte|NIF|NIF:|cartão de cidadão|número da segurança social|IBAN|IBAN:|conta bancária|conta|deposite a renda em|bilhete de identidade n.º|carta de condução|documento", "caduca em breve|como comprovativo|até ao fim do mês| consta do processo"),
    },
    "street_address": {
        "en": ("we moved to|ship it to|deliver the keys to|our office is at|her flat is at|meet me outside|the clinic at|Postal address:|registered office:|he was born at|return to sender:|home:|address|invoice to:", "next month|on the third floor|, ring twice| opens at nine|behind the bakery|, thank you"),
        "fr": ("nous avons déménagé au|livrez la commande au|notre bureau se trouve|adresse postale :|siège social :|domicilié|rendez-vous au|elle loge", "le mois prochain|au troisième étage|, sonnez deux fois| ouvre à neuf heures"),
        "de": ("wir sind umgezogen in die|liefern Sie an|unser Büro ist in der|Postanschrift:|Firmensitz:|wohnhaft|Treffpunkt|er wohnt jetzt|zu Hause:|Adresse:", "im dritten Stock|, zweimal klingeln| öffnet um neun|ab nächstem Monat"),
        "es": ("nos hemos mudado a|entregue el pedido en|nuestra oficina está en|dirección postal:|sede social:|domiciliado en|nos vemos en|su piso está en", "el mes que viene|en el tercer piso|, llame dos veces| abre a las nueve"),
        "pt": ("mudámo-nos para a|entregue a encomenda na|o nosso escritório fica na|endereço postal:|sede:|residente na|encontramo-nos na|a casa dele é na", "no próximo mês|no terceiro andar|, toque duas vezes| abre às nove"),
    },
    "person_name": {
        "en": ("yesterday|thanks to|I spoke with|the report by|our new colleague|Mr|Mrs|Ms|Mr.|Dr|Dr.|Prof.|Sir|Hello|Hi|Dear|interview with|as told by|chaired by|nurse|the patient|author:|Name:|from|and|met|kind regards,|Best wishes,\n|Sincerely,\n|his sister|tenant|for|by", "joined the team|will present the budget|was elected chair|called in sick|, head of sales,|and his brother|said no|agreed|lost the keys|, who lives alone,|is on leave|retired in May|'s office|won|(born 1961)|, welcome back|has the last word"),
        "fr": ("hier|grâce à|j'ai parlé avec|le rapport de|notre collègue|M.|Mme|Mlle|Monsieur|Madame|Dr|Pr|Bonjour|Cher|Chère|selon|présidé par|auteur :|Nom :|et|cordialement,\n|la patiente|le docteur|par", "a rejoint l'équipe|présentera le budget|a été élu président|est malade|, directrice des ventes,|et son frère|a refusé|a perdu les clés|est en congé|dirige le service"),
        "de": ("gestern|dank|ich sprach mit|der Bericht von|unsere Kollegin|Herr|Herrn|Frau|Dr.|Prof.|Hallo|Guten Tag|Sehr geehrter Herr|Sehr geehrte Frau|laut|geleitet von|Autor:|Name:|und|Mit freundlichen Grüßen\n|Patient|von|Liebe|Lieber", "kam ins Team|stellt den Haushalt vor|wurde zum Vorsitzenden gewählt|ist krank|, Leiterin des Vertriebs,|und sein Bruder|lehnte ab|hat Urlaub|leitet die Abteilung"),
        "es": ("ayer|gracias a|hablé con|el informe de|nuestra compañera|Sr.|Sra.|Señor|Señora|Dr.|Dra.|Don|Doña|Hola|Estimado|Estimada|según|presidido por|autor:|Nombre:|y|atentamente,\n|la paciente|por", "se unió al equipo|presentará el presupuesto|fue elegida presidenta|está enferma|, jefe de ventas,|y su hermano|dijo que no|está de vacaciones|dirige el servicio"),
        "pt": ("ontem|graças a|falei com|o relatório de|a nossa colega|Sr.|Sra.|Senhor|Senhora|Dr.|Dra.|Dom|Olá|Caro|Cara|segundo|presidido por|autor:|Nome:|e|atenciosamente,\n|a doente|por", "juntou-se à equipa|vai apresentar o orçamento|foi eleita presidente|está doente|, chefe de vendas,|e o irmão|disse que não|está de férias|dirige o serviço"),
    },
}

# Sentences without a value; P: a place, N: a number, T: a thing that looks like a value and is none (fixed values).
PLAIN: dict[str, list[str]] = {
    "en": ["The committee met in P last autumn to discuss water prices.", "P Castle was rebuilt after the fire of N.", "Only N of the tickets were sold.", "South P is colder than Upper P.", "We took the night train from P to P.", "Version T fixes the crash.", "Rainfall reached N mm in P, a record.", "The University of P opened a new lab.", "Cells were kept at T for an hour.", "Turn left at P Square and follow the river.", "On Monday the Central Bank raised rates.", "Black tea, rye bread, plums and T.", "See chapter N, and T.", "Item T is out of stock", "Nobody at P Museum knew why.", "As of T the lake is frozen.", "I think it's fine, but ask again in June.", "What a day!", "Lower P Valley Railway timetable", "Does anyone in P sell maps", "posted by T at noon", "P-N was delayed; T was not.", "The P Review called it dull.", "Old habits in new towns: a P story"],
    "fr": ["La commission s'est réunie à P cet automne.", "Le château de P fut rebâti en N.", "Seuls N billets ont été vendus.", "Nous avons pris le train de nuit de P à P.", "La version T corrige le défaut.", "L'Université de P ouvre un laboratoire.", "Tournez à gauche place de P, puis suivez la rivière.", "Lundi, la Banque centrale a relevé ses taux.", "Voir le chapitre N et T.", "L'article T est épuisé", "Qui vend des cartes à P ?", "Au T, le lac est gelé.", "Le musée P ferme tôt.", "Haute-P et Basse-P se ressemblent."],
    "de": ["Der Ausschuss tagte im Herbst in P.", "Schloss P wurde nach dem Brand von N wieder aufgebaut.", "Nur N Karten wurden verkauft.", "Wir nahmen den Nachtzug von P nach P.", "Version T behebt den Absturz.", "Die Universität P eröffnet ein Labor.", "Am Montag hob die Zentralbank den Leitzins.", "Siehe Kapitel N und T.", "Artikel T ist vergriffen", "Wer verkauft Landkarten in P?", "Am T war der See gefroren.", "Das Museum P schließt früh, sagt der Leiter.", "Alte Stadt, neue Gleise: Bahnhof P Nord", "Ob Regen fällt, weiß in P niemand.", "Die Gassen von P sind eng.", "Alle Schulen von P bleiben zu.", "Kinder aus P singen Lieder von P."],
    "es": ["La comisión se reunió en P el otoño pasado.", "El castillo de P se reconstruyó en N.", "Solo se vendieron N entradas.", "Tomamos el tren nocturno de P a P.", "La versión T corrige el fallo.", "La Universidad de P abrió un laboratorio.", "El lunes el Banco Central subió los tipos.", "Véase el capítulo N y T.", "El artículo T está agotado", "¿Alguien vende mapas en P?", "A fecha de T el lago está helado.", "El Museo P cierra pronto."],
    "pt": ["A comissão reuniu-se em P no outono.", "O castelo de P foi reconstruído em N.", "Só se venderam N bilhetes.", "Apanhámos o comboio noturno de P para P.", "A versão T corrige a falha.", "A Universidade de P abriu um laboratório.", "Na segunda-feira o Banco Central subiu as taxas.", "Ver o capítulo N e T.", "O artigo T está esgotado", "Alguém vende mapas em P?", "Em T o lago está gelado.", "O Museu P fecha cedo."],
}

# Dates, times, amounts, lots, readings, versions, references, handles. 9: a digit; Q: a capital; p: a place in lower case; P: a place.
OTHERS = [
    "2099-99-99", "99/99/2099", "9.9.2099", "99.99.99", "99:99", "99:99:99", "$9,999.99", "9.999,99 €", "€ 99", "9 999 999 units", "99 999 km", "v9.9", "9.99.9", "99.9 %", "pH 9.9", "99 °C", "-99 °F", "9.9 x 10-9", "99-99",
    "lot 99999", "lot Q9999-99", "no. 99999/99", "batch QQ-999", "room 999", "gate Q99", "p. 999", "pp. 999-999", "fig. 9.9", "[99]", "(99)", "ISBN 999-9-99-999999-9", "doi 99.9999/q99999", "Q99QQ9", "QQQ9", "9999 hits", "9999.999 kDa", "99 m/z 999.9999",
    "@p", "@p_99", "@the_p", "#p", "#99999", "~99", "x9", "24/7", "A4", "CO2", "H2O", "1st", "line 99999999", "99 h @ 99 rpm", "Q.E.D.", "<b>99</b>", "www.p.org", "https://p.net/99", "-- 99 --", "99999 rows", "99 + 99 = 999", "chr9:999999-999999", "99°99'N", "flight QQ9999", "bus 99", "5 @ 9.99", "plate QQ-Q 999", "sample 999-99-9", "99 999 votes", "order 99999999",
    "9.999.999", "9.999.999 units", "€ 99.999,99", "9,999,999", "999 999", "99 999 999", "9.999,99 999", "9999-9999", "lines 9999-9999", "ids 9999-9999", "99.9999", "9999.9999 Da", "plate 99-999", "seat 99-99", "gate 99", "lot 99999/99",
]

# Words of grammar, which begin sentences with a capital (fixed values).
GRAMMAR = {
    "en": "the a an this that these those it he she we they you I is are was were do does did has have had can could will would may should if when while as but or so then what who why how where there here no not yes some all each every both many most its his her their our my your now then by on with without about after before during between because only even still just".split(),
    "fr": "le la les un une des ce cette ces il elle nous vous ils elles on je tu est sont était ont avait peut sera si quand comme mais ou donc alors que qui quoi où pourquoi comment ici là non oui tout chaque plusieurs son sa ses leur notre votre mon est-ce maintenant par sur avec sans avant pendant parce seulement encore aussi".split(),
    "de": "der die das ein eine einen dem den dieser diese dieses es er sie wir ihr ich ist sind war waren hat haben hatte kann konnte wird würde soll wenn als während aber oder so dann was wer warum wie wo da hier nein nicht ja alle jeder beide viele sein ihre unser mein jetzt durch auf mit ohne vor nach zwischen weil nur noch auch".split(),
    "es": "el la los las un una este esta estos eso él ella nosotros ellos yo tú es son era fue ha han había puede será si cuando mientras como pero o así entonces qué quién porque cómo dónde allí aquí no sí todo cada ambos muchos su sus nuestro mi ahora por con sin antes durante solo aún también lo al del".split(),
    "pt": "o a os as um uma este esta estes isso ele ela nós eles eu tu é são era foi há tem tinha pode será se quando enquanto como mas ou assim então que quem porque onde ali aqui não sim tudo cada ambos muitos seu sua nosso meu agora por com sem antes durante só ainda também lhe ao do da no na".split(),
}

# What stands beside a place in the name of something that is no person, and what leads to a place (fixed values).
LANDMARKS = "Bridge Archive Museum Station Park Tower Library Hospital School River Mountain Valley Church Airport Port Hall Gate Market University College Institute Office Bank Company Association Council Court Abbey Forest Island Theatre Club Review".split()
SIDES = "North South East West Upper Lower Old New Greater Lake Mount Port Saint Central".split()
TOWARDS = {
    "en": "In At From Near Outside Around Beyond Towards To Until Since Via Like Unlike".split(), "fr": "À De Depuis Vers Dans Selon Sous Entre Pour Chez En Après".split(),
    "de": "In Ab Bei Nach Von Aus Laut Gegen Um Zu Unter Seit".split(), "es": "En Desde Hacia Según Para Sobre Entre Sin Hasta De Tras".split(), "pt": "Em Desde Para Segundo Sobre Entre Sem Até De Por Após".split(),
}

# Names of many countries (fixed values).
GIVEN = (
    "Olivia Liam Amara Noah Mateo Sofia Lukas Hannah Jonas Klara Felix Greta Antoine Camille Lucie Hugo Inès Javier Lucía Diego Carmen Pablo Elena João Beatriz Tiago Inês Rui Marta Giulia Marco Chiara Luca Francesca Sven Astrid Lars Ingrid Mikkel Freja "
    "Aino Eero Piotr Agnieszka Jan Zofia Dmitri Olga Ivan Natalia Andrei Ioana Viktor Petra Marek Jana Ahmed Fatima Omar Layla Hassan Yasmin Mehmet Ayşe Emre Zeynep Ravi Anjali Arjun Meera Sanjay Lakshmi Wei Li Ming Xiu Hiroshi Yuki Kenji Akiko Minjun Jiwoo Thanh Linh Chidi Ngozi Tunde Zuri Thabo Lerato "
    "William Emma James Charlotte Henry Grace Thomas Ruth Peter Alice Samuel Edith Daniel Laura Robert Helen Michael Susan David Karen George Nora Édouard Zoë "
    "Maria Anna Lucia Andrea Stefan Martin Julia Nina Tina Erika Monika Brigitte Renate Dieter Wolfgang Günter Karin Marie Pierre Jean Jacques Michel Nicole Valérie Thierry Pascal Ana Rosa Teresa Pilar Manuel Antonio Fernando Rafael Ricardo Eduardo Paula Rita Vasco Sergio Paolo Anita Maya Nikhil Rohan Aisha Karim Samir Leila Tariq Boris Milena Goran Katarina Ewa Lech Erik Nils"
).split()
FAMILY = (
    "Johnson Williams Brown Taylor Davies Wilson Evans Roberts Walker Wright Thompson Hughes Edwards Clarke Harris Cooper Morgan Bennett Müller Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Martin Bernard Dubois Laurent Lefebvre Moreau Girard Roux Fontaine Chevalier "
    "García Fernández López Martínez Sánchez Romero Navarro Torres Domínguez Vázquez Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Rossi Russo Ferrari Esposito Bianchi Hansen Larsen Andersson Nilsson Virtanen Korhonen Kowalski Nowak Wiśniewska Ivanov Petrova Popescu Horvat Novák Nagy Yılmaz Demir Al-Sayed Haddad "
    "Khan Rahman Patel Sharma Gupta Iyer Singh Chen Wang Zhang Tanaka Suzuki Watanabe Park Kim Nguyen Tran Okonkwo Adeyemi Mwangi Dlamini Nkosi O'Brien MacDonald Fitzgerald "
    "Anderson Jackson Robinson Harrison Mitchell Campbell Stewart Turner Parker Fisher Potter Hamilton Burton Walton Holloway Bradley Ashby Kirby Hoffman Lehmann Zimmermann Neumann Bergmann Hartmann Kaufmann Krüger Keller Vogel Engel Roth Durand Renard Leclerc Dupont Marchand Garnier-Roy Herrera Carrera Moreno Castillo Morales Rojas Cardoso Almeida Barros Lopes Gomes Nunes Teixeira Conti Moretti Bellini Jensen Olsen Lindgren Berglund Nieminen Kaczmarek Nowicki Petrov Sokolov Ilić Kovač Reddy Menon Nair Das Mukherjee"
).split()

# First and last parts of addresses (fixed values): s a street name, n a house number, u a small number.
STREETS: dict[str, list[str]] = {
    "en": ["{n} {s} Street", "{n} {s} Road", "{n} {s} Avenue", "{n} {s} Lane", "{n} {s} Drive", "{n} {s} St", "{n} {s} Rd.", "{n} {s} St.", "{n} {s} St.", "{n} {s} Ave.", "{n} {s} Ave", "{n} {s} Close", "{n} {s} Crescent", "{n} {s} Court", "{n} {s} Court, Unit {u}", "{n} {s} Boulevard, Apt {u}", "Flat {u}, {n} {s} Road", "Apt. {u}, {n} {s} Way", "Unit {u}, {n} {s} Place", "{n} {s} Square, Floor {u}", "{n} {s} Terrace, Unit {u}", "Suite {u}, {n} {s} Plaza", "{n} North {s} Street"],
    "fr": ["{n}, rue de {s}", "{n} rue {s}", "{n}, avenue de la {s}", "{n} bis, avenue {s}", "{n}, boulevard {s}", "{n} chemin des {s}", "{n} ter, place {s}", "{n}, impasse du {s}", "{n} allée {s}", "{n} avenue {s}", "{n} boulevard {s}", "{n} place {s}", "Appartement {u}, {n} rue {s}", "{n}, quai de {s}, bât. {u}", "{n} chemin du {s}"],
    "de": ["{s}straße {n}", "{s}str. {n}", "{s}weg {n}", "{s}gasse {n}", "{s}platz {n}", "{s}allee {n}", "{s}-Straße {n}", "{s}-Allee {n}", "Am {s} {n}", "An der {s} {n}", "Im {s} {n}", "{s}ring {n}", "{s}ufer {n}, {u}. OG", "{s}damm {n}", "Alte {s}straße {n}"],
    "es": ["Calle {s} {n}", "Calle de {s}, {n}", "C/ {s}, {n}", "C/ {s} {n}, {u}.º A", "Avenida {s} {n}", "Avda. de {s}, {n}", "Avda. {s} {n}", "Plaza de {s}, {n}", "Paseo del {s}, {n}, {u}.º B", "Camino {s}, {n}", "Ronda de {s} {n}"],
    "pt": ["Rua {s}, {n}", "Rua de {s}, n.º {n}", "Rua do {s} {n}, {u}.º Esq.", "Avenida {s}, {n}", "Av. {s} {n}", "Av. de {s}, {n}, {u}.º Dto.", "Travessa {s}, {n}", "Travessa da {s}, n.º {n}", "Praça {s}, {n}", "Largo do {s} {n}", "Estrada de {s}, {n}"],
}

_ONSETS = "b br c ch d dr f fl g gl h j k kr l m n p pl qu r s sk sl st t th tr v w y z".split()
_VOWELS = "a e i o u a e i o ai ea ou y".split()
_CODAS = "b ck d ff l ll lm m n nd ng nt p r rd rn rt s sh sk ss st t th x z".split()
_TOWN_ENDS = "ton ham ford burg berg stadt ville court haven mouth dale field wick bach feld mont sur mar ora ia el".split()
_STREET_NAMES = "Oak Maple High Mill Church Station King Queen Park Garden River Spring Bridge Rose Victoria Linden Garten Bahnhof Schiller Mozart Kirch Berg République Liberté Victor-Hugo Fleurs Moulin Mayor Sol Constitución Goya Cervantes Flores Liberdade Comércio Camões".split()


def word_of(r: random.Random, least: int = 1, most: int = 3) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) for _ in range(r.randint(least, most))) + r.choice(_CODAS)


def _pool(lang: str) -> list[str]:
    """Words of the wording of a language, from five letters."""
    said = [*PLAIN[lang], *(w for by in AROUND.values() for w in by[lang])]
    return sorted({w.lower() for w in re.findall(r"[^\W\d_]{5,}", " ".join(said))})


_POOLS = {lang: _pool(lang) for lang in LANGS}


def blend(r: random.Random, lang: str) -> str:
    """The head of one word of the language with the tail of another: no word, yet with the letters of the language."""
    a, b = r.choice(_POOLS[lang]), r.choice(_POOLS[lang])
    return a[: r.randint(2, len(a) - 2)] + b[-r.randint(2, len(b) - 2) :]


def place(r: random.Random) -> str:
    """A town or street name made from syllables, or from the letters of a language."""
    if r.random() < 0.25:
        return blend(r, r.choice(LANGS)).capitalize()
    out = word_of(r, 1, 2) + (r.choice(_TOWN_ENDS) if r.random() < 0.4 else r.choice(_VOWELS) + r.choice(_CODAS))
    return out.capitalize()


def _digits(n: int, r: random.Random) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def filled(form: str, r: random.Random) -> str:
    """9 stands for a digit, Q and q for a letter, P and p for a place; other letters stay."""
    out = []
    for i, c in enumerate(form):
        alone = (i == 0 or not form[i - 1].isalpha()) and (i + 1 == len(form) or not form[i + 1].isalpha())
        if c == "9":
            out.append(r.choice("0123456789"))
        elif c == "Q" and not form.startswith("Q.E"):
            out.append(r.choice("ABCDEFGHIJKLMNOPRSTUVWXYZ"))
        elif c == "q":
            out.append(r.choice("abcdefghijk"))
        elif c == "P" and alone:
            out.append(place(r))
        elif c == "p" and alone and not form.startswith("p."):
            out.append(place(r).lower())
        else:
            out.append(c)
    return "".join(out)


class Values:
    def __init__(self, r: random.Random, given: Sequence[str], family: Sequence[str]):
        self.r, self.given, self.family = r, given, family

    def _one(self, listed: Sequence[str], cut: int, others: Sequence[str], source: float) -> str:
        a, b = self.r.choice(listed), self.r.choice(listed)
        if source < 0.2:
            return a
        if source < 0.38:
            return a[:cut] + b[cut:]
        return self.r.choice(others)

    def names(self) -> tuple[str, str]:
        """A given and a family name, mostly of one source."""
        x = self.r.random()
        y = x if self.r.random() < 0.75 else self.r.random()
        return self._one(self.given, 3, GIVEN, x), self._one(self.family, 4, FAMILY, y)

    def person_name(self) -> str:
        r = self.r
        g, f = self.names()
        i = r.choice("ABCDEFGHIJKLMNOPRSTVWZ")
        return r.choices(
            [f"{g} {f}", f"{f}, {g}", f"{g} {i}. {f}", f"{i}. {f}", f"{g} {i}.", f"{g} {f}-{self.names()[1]}", f"{i}. {r.choice('ABCDEKLM')}. {f}", f"{g} {self.names()[0]} {f}", f"{g} {r.choice(['de', 'da', 'Le', 'La', 'Mac', 'Van', 'Di'])} {f}", f"{f}, {i}."],
            [40, 12, 11, 10, 7, 9, 3, 4, 2, 2],
        )[0]

    def email(self) -> str:
        r = self.r
        g, f = (n.lower().replace("'", "").replace(" ", "") for n in self.names())
        word = r.choice(["info", "office", "sales", "hello", "admin", "team", "contact", "support"])
        local = r.choice([f"{g}.{f}", f"{g}.{f}", f"{f}.{g}", f"{g}_{f}", f"{f}_{g}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}{r.randint(1, 2010)}", f"{word}-{f}", f"{g}-{f}", f"{g}.{f}+{word}", word, f"{word}.{g}", f"{f}{g[0]}"])
        local = local.translate(str.maketrans("áàâãäåçćčéèêëíìîïıñńóòôõöøśşšúùûüýžźğ", "aaaaaaccceeeeiiiiinnoooooosssuuuuyzzg"))
        domain = r.choice(["", "", "", "mail.", "post.", "dept.", "eu."]) + place(r).lower() + r.choice(["", "", "-group", "-lab", "-bank", "soft"])
        top = r.choice(["example", "com", "org", "net", "edu", "gov", "co.uk", "fr", "de", "es", "pt", "io", "invalid", "test"])
        at, dot = r.choice([("@", ".")] * 8 + [(" @ ", "."), ("＠", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("{at}", ".")])
        out = f"{local}{at}{domain}{dot}{top}"
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        """National and international forms: a code, an area in brackets or not, groups of digits, an extension."""
        r = self.r
        sep = r.choice([" ", " ", " ", "-", ".", ""])
        if r.random() < 0.07:
            return "+" + _digits(r.randint(11, 13), r)
        # Groups of the numbering plans of Britain, North America, France, Germany, Spain and Portugal, or any groups.
        plan = r.choice(["0-2 4 4", "0-2 4 4", "0-2 4 4", "0-2 4 4", "0-3 3 4", "0-4 6", "3 3 4", "3 3 4", "3 3 4", "3 4", "3 4", "0-1 2 2 2 2", "0-1 2 2 2 2", "0-2 8", "0-2 5 3", "0-3 7", "0-3 4 3", "2 3 2 2", "3 2 2 2", "3 3 3", "2 3 4", "1 8", "any", "any"])
        if plan == "any":
            plan = f"{r.choice(['', '0-'])}{r.choice([2, 3, 4, 5])} " + r.choice(["3 4", "4 4", "3 3 3", "2 2 2 2", "6", "7", "4 3", "3 2 2", "4 6", "5"])
        zero, plan = plan.startswith("0-"), plan.removeprefix("0-")
        groups = [_digits(int(g), r) for g in plan.split()]
        abroad = r.random() < 0.42
        if abroad:
            code = r.choice(["+", "+", "+", "+", "00"]) + r.choice(["1", "1", "44", "33", "49", "34", "351", "39", "46", "48", "55", "91", "353", _digits(2, r), _digits(3, r), _digits(3, r)])
            area = groups[0] if len(groups) < 3 or r.random() < 0.75 else r.choice([f"({groups[0]})", f"(0){groups[0]}", f"(0) {groups[0]}"])
            rest = groups[1:]
            out = code + (sep if sep or "(" not in area else " ") + area + (sep or (" " if "(" in area else "")) + (sep or "").join(rest)
            if sep and len(rest) > 1 and r.random() < 0.25:  # another mark before the last group
                out = out.removesuffix(sep + rest[-1]) + ("-" if sep == " " else " ") + rest[-1]
            elif sep and r.random() < 0.2:  # the code stands off with a space, or the last groups are glued
                out = r.choice([f"{code} {sep.join([area, *rest])}", f"{code}{sep}{area}{sep}{''.join(rest)}"])
        else:
            first = ("0" if zero else "") + groups[0]
            rest = (sep or "").join(groups[1:])
            out = r.choice([f"{first}{sep}{rest}"] * 4 + [f"{first} {rest}", f"({first}) {rest}", f"({first}){rest}" if len(groups) < 3 else f"({first}) {rest}", f"{first}/{rest}", f"{first}-{rest}"])
        if sum(c.isdigit() for c in out) < 7:
            out += (sep or "") + _digits(4, r)
        x = r.random()
        return out + (f" x{r.randint(10, 9999)}" if x < 0.06 else f" ext. {r.randint(10, 999)}" if x < 0.12 else f" ext {r.randint(10, 999)}" if x < 0.15 else f"-{r.randint(10, 99)}" if x < 0.2 else f", extension {r.randint(10, 99)}" if x < 0.22 else "")

    def id_number(self) -> str:
        """A number of one of the forms; one in six stands for an example and begins with noughts."""
        out = self._id_number()
        digits = re.search(r"\d{2,3}", out)
        return out[: digits.start()] + "0" * len(digits[0]) + out[digits.end() :] if digits and self.r.random() < 0.17 else out

    def _id_number(self) -> str:
        """Account, passport, social, tax and card numbers as states and banks write them, with varying marks between."""
        r = self.r
        cap = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))
        sep = r.choice([" ", " ", "-", "", "."])
        form = r.randrange(13)
        if form == 12:
            form = 7
        if form < 2:  # account number of 15 to 28 characters, in fours or in one
            body = _digits(2, r) + (cap(4) if r.random() < 0.2 else "") + _digits(r.choice([10, 12, 14, 16, 18, 20, 22]), r)
            whole = cap(2) + body
            return whole if r.random() < 0.45 else r.choice([" ", " ", "-"]).join(whole[i : i + 4] for i in range(0, len(whole), 4))
        if form < 4:  # social number 3-2-4
            s = r.choice(["-", " ", "-", " ", ""])
            return f"{_digits(3, r)}{s}{_digits(2, r)}{s}{_digits(4, r)}"
        if form < 5:  # insurance number: two letters, three pairs, a letter
            return sep.join([cap(2), _digits(2, r), _digits(2, r), _digits(2, r), cap(1)])
        if form < 7:  # passport
            return r.choice([cap(1) + _digits(8, r), cap(2) + _digits(7, r), _digits(9, r), cap(1) + _digits(7, r) + cap(1), cap(2) + _digits(6, r), cap(1) + cap(1) + _digits(1, r) + cap(2) + _digits(4, r), _digits(2, r) + cap(2) + _digits(5, r), cap(3) + _digits(6, r)])
        if form < 8:  # tax number of 11 digits, in 2 3 3 3, or with a bar
            return r.choice([sep.join([r.choice(["00", _digits(2, r)]), _digits(3, r), _digits(3, r), _digits(3, r)]), _digits(11, r), f"{_digits(3, r)}/{_digits(4, r)}/{_digits(4, r)}", sep.join([_digits(3, r), _digits(3, r), _digits(3, r)])])
        if form < 10:  # identity card: 8 digits and a letter, with dots, with a dash
            d = _digits(8, r)
            return r.choice([d, f"{d[:2]}.{d[2:5]}.{d[5:]}", f"{d[:2]} {d[2:5]} {d[5:]}", d]) + r.choice(["-", "", "", " "]) + cap(1) if r.random() < 0.8 else f"{r.choice('XYZ')}{r.choice(['', '-'])}{_digits(7, r)}{r.choice(['', '-'])}{cap(1)}"
        if form < 11:  # date of birth and a serial number
            return f"{_digits(6, r)}{r.choice(['-', '-', '+', ' ', ''])}{_digits(4, r)}"
        return " ".join([_digits(1, r), _digits(2, r), _digits(2, r), _digits(2, r), _digits(3, r), _digits(3, r), _digits(2, r)]) if r.random() < 0.5 else sep.join(_digits(4, r) for _ in range(r.choice([3, 4])))

    def street_address(self, lang: str) -> str:
        r = self.r
        n = str(r.randint(1, 320)) + r.choice(["", "", "", "", " a", "b", "C", "-" + str(r.randint(2, 99))])
        street = place(r) if r.random() < 0.7 else r.choice(_STREET_NAMES)
        out = r.choice(STREETS[lang]).format(n=n, s=street, u=r.randint(1, 40))
        if lang == "en" and r.random() < 0.15:
            out += f", {r.choice(['Unit', 'Apt', 'Apt.', 'Floor', 'Flat', 'Suite'])} {r.randint(1, 40)}"
        if r.random() < 0.66:
            town, cap = place(r), lambda k: "".join(r.choice("ABCDEFGHLMNPRSTW") for _ in range(k))
            code = r.choice([_digits(5, r), _digits(5, r), _digits(4, r), f"{cap(2)}{_digits(1, r)} {_digits(1, r)}{cap(2)}", f"{cap(1)}{_digits(2, r)} {_digits(1, r)}{cap(2)}", f"{cap(2)} {_digits(5, r)}", f"{_digits(4, r)}-{_digits(3, r)}"])
            if lang != "en":
                code = r.choice([_digits(5, r), _digits(5, r), _digits(5, r), _digits(4, r), f"{_digits(4, r)}-{_digits(3, r)}"])
            tail = f"{town} {code}" if lang == "en" and r.random() < 0.8 else f"{code} {town}" if r.random() < 0.9 else town
            out += r.choice([", ", ", ", ", ", "\n", "\n", " "]) + tail
        return out


def reworded(s: str, r: random.Random, share: float, lang: str, nouns: bool = False) -> str:
    """Some words, with ``nouns`` also capital ones within a sentence, give way to words made of syllables, so that not the word but its shape and place are learnt."""

    def other(m: re.Match[str]) -> str:
        w = m[0]
        if r.random() >= share or not (w.islower() or w.istitle() and (nouns or m.start() == 0) and not re.match(r"\S+ P\b", s[m.start() :])):
            return w
        new = blend(r, lang) if r.random() < 0.6 else word_of(r) if r.random() < 0.8 else word_of(r, 1, 1)
        return new.capitalize() if w.istitle() else new

    return re.sub(r"[^\W\d_]{3,}", other, s)


def _place_or_more(r: random.Random) -> str:
    x = r.random()
    if x < 0.7:
        return place(r)
    if x < 0.8:
        return f"{place(r)} {r.choice(LANDMARKS)}"
    return f"{r.choice(SIDES)} {place(r)}" + (f" {r.choice(LANDMARKS)}" if r.random() < 0.6 else "")


def _sentence(lang: str, r: random.Random) -> str:
    """A plain sentence with its places, numbers and other things filled in."""
    s = reworded(r.choice(PLAIN[lang]), r, r.choice([0.0, 0.0, 0.3, 0.7]), lang, lang == "de")
    if r.random() < 0.15:  # torn text: words are lost, and a place or the start of another sentence stands in between
        w = s.split(" ")
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(w))
            x = r.random()
            if x < 0.45 and len(w) > 3:
                del w[k]
            elif x < 0.75:
                w.insert(k, "P")
            else:
                w[k:] = reworded(r.choice(PLAIN[lang]), r, 0.5, lang, lang == "de").split(" ")
        s = " ".join(w)
    out = []
    for w in s.split(" "):
        core = w.strip(".,;:?!")
        if core in ("P", "P-N", "Haute-P", "Basse-P"):
            w = w.replace("P", _place_or_more(r) if core == "P" else place(r)).replace("N", str(r.randint(2, 999)))
        elif core == "N":
            w = w.replace("N", str(r.randint(2, 9999)))
        elif core == "T":
            w = w.replace("T", filled(r.choice(OTHERS), r))
        out.append(w)
    s = " ".join(out)
    x = r.random()
    if lang == "es" and x < 0.1:
        s = f"¿{blend(r, lang).capitalize()} {s.rstrip('.?!')}?"
    elif x < 0.12:
        s = f"{r.choice(GRAMMAR[lang]).capitalize()} {s[0].lower() + s[1:]}"
    elif x < 0.35:
        s = f"{r.choice(TOWARDS[lang])} {_place_or_more(r)}{r.choice([',', ',', ''])} {s[0].lower() + s[1:]}"
    elif x < 0.5:
        s = s.rstrip(".?!") + f" {r.choice(TOWARDS[lang]).lower()} {_place_or_more(r)}" + r.choice([".", ""])
    elif x < 0.56:
        s = s.rstrip(".?!")
    return s


def labelled_rows(given: Sequence[str], family: Sequence[str], n: int = 3000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    r = random.Random(seed)
    values = Values(r, sorted(given), sorted(family))
    rows = []
    for k in range(n):
        text, spans = "", []
        lang = LANGS[r.randrange(5)]

        def add(kind: str, torn: float = 1.0) -> None:
            nonlocal text
            v = values.street_address(lang) if kind == "street_address" else getattr(values, kind)()
            if kind == "person_name" and r.random() < 0.07 or kind == "street_address" and r.random() < 0.03:
                v = v.upper()
            spans.append((len(text), len(text) + len(v), kind))
            text += v
            often = torn * (1.5 if kind == "street_address" else 0.6)
            if r.random() < 0.15 * often:
                text += " " + (r.choice(GRAMMAR[lang]) if r.random() < 0.5 else blend(r, lang))
            elif r.random() < 0.15 * often:
                w = r.choice([r.choice(GRAMMAR[lang]), r.choice(TOWARDS[lang]), blend(r, lang), blend(r, lang)]).capitalize()
                text += f" {w} {r.choice(GRAMMAR[lang])}" if r.random() < 0.6 else f" {w} {place(r)}"

        def close() -> None:
            nonlocal text
            if not text[-1].isspace():
                text += r.choice([".", ".", ".", "", "", ";", "!", "?"] if text[-1] != "." else ["", "", ";"])

        for part in range(r.choice([1, 1, 2, 3, 4])):
            if text:
                text += r.choice([" ", " ", " ", "  ", "\n"])
            x = r.random()
            if r.random() < 0.36:  # common words around a name or a place
                noun = lambda w: w.capitalize() if lang == "de" and r.random() < 0.35 else w
                word = lambda: r.choice(GRAMMAR[lang]) if r.random() < 0.5 else noun(blend(r, lang) if r.random() < 0.7 else word_of(r))
                head = " ".join(word() for _ in range(r.choice([0, 0, 1, 2, 3, 5])))
                text += head[:1].upper() + head[1:] + (" " if head else "")
                if r.random() < 0.8:
                    add("person_name", 0.0)
                    if r.random() < 0.2:
                        text += r.choice([f" {r.choice(GRAMMAR[lang][:1] + ['and', 'et', 'und', 'y', 'e'])} ", ", "])
                        add("person_name", 0.0)
                elif r.random() < 0.5:
                    text += place(r)
                else:  # a thing of a place, or in German a thing beside a place
                    thing = blend(r, lang)
                    thing = thing.capitalize() if lang == "de" else thing
                    of = {"en": "of", "fr": "de", "de": r.choice(["von", "von", "von", ""]), "es": "de", "pt": "de"}[lang]
                    text += " ".join(x for x in (thing, of, place(r)) if x)
                tail = " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 5])))
                text += r.choice([" ", " ", " ", ", "]) + tail if tail else ""
                close()
            elif x < 0.3:
                s = _sentence(lang, r)
                if r.random() < 0.45:
                    w = s.split(" ")
                    w.insert(r.randint(0, len(w)), filled(r.choice(OTHERS), r))
                    s = " ".join(w)
                y = r.random()
                text += s.upper() if y < 0.1 else s.lower() if y < 0.16 else s
            elif x < 0.36:
                text += filled(r.choice(OTHERS), r)
            elif x < 0.74:
                kind = KINDS[(k + part) % 5]
                before, after = (a.split("|") for a in AROUND[kind][lang])
                start = r.random() < (0.3 if kind == "person_name" else 0.1) and kind != "id_number"
                if not start:
                    b = r.choice(before)
                    if kind != "id_number" or r.random() < 0.4:  # what an id number is, only words say
                        b = reworded(b, r, r.choice([0.0, 0.0, 0.4, 0.8]), lang)
                    if r.random() < 0.2:
                        b = f"{word_of(r)} {b}"
                    b = b[0].upper() + b[1:] if r.random() < 0.7 else b
                    text += b + ("" if b[-1] in "\n<(" or b.endswith("to:") else " ")
                add(kind)
                if start or r.random() < 0.55:
                    a = reworded(r.choice(after), r, r.choice([0.0, 0.4, 0.9]), lang)
                    text += a if a[0] in " ,')>" else " " + a
                close()
            elif x < 0.9:  # a value in the middle of plain text, set off by a mark, or after a comma list
                kind = r.choice(KINDS)
                s = _sentence(lang, r).rstrip(".?!")
                open_, shut = r.choice([(" - ", ""), (", ", ""), (" (", ")"), (" / ", ""), (": ", "."), (" | ", " |"), ("; ", "."), (" – ", "."), (" [", "]"), (", ", ";")])
                text += s + open_
                add(kind)
                text += shut
            elif x < 0.95:  # several values in one line
                for j, kind in enumerate(r.sample(KINDS, r.randint(2, 3))):
                    text += ("", r.choice([", ", "; ", " | ", " / ", " - "]))[j > 0]
                    add(kind)
            else:  # the foot of a letter
                text += r.choice(["\n--\n", "--\n", "\n\n", "\n-- \n"])
                add("person_name")
                for kind in r.sample(["phone", "email", "street_address"], r.randint(1, 3)):
                    text += "\n" + r.choice(["", "", {"phone": "Tel: ", "email": "Mail: ", "street_address": ""}[kind]])
                    add(kind)
        rows.append((text, spans))
    return rows
