"""Own reference data for the fixture views (phrases, word lists, lexicon).

All texts here were written for this project.  The phrase table holds twelve
ticket "concepts" (two per intent) written in five languages, so that the
same concept id gives a parallel translation, plus edge rows in English that
exercise URL and e-mail masking, blank text, a literal ``%``, whitespace
runs, mixed case and truncation.
"""

from __future__ import annotations

LANGS = ["en", "es", "fr", "de", "pt"]

# (concept_id, intent, urgency, {lang: text})
CONCEPTS = [
    (1, "billing", "high", {
        "en": "The same payment left my card two times, please help me with the refund",
        "es": "El mismo pago salió dos veces de mi tarjeta, necesito ayuda con el reembolso",
        "fr": "Le même paiement a quitté ma carte deux fois, j'ai besoin d'aide pour le remboursement",
        "de": "Dieselbe Zahlung ging zweimal von meiner Karte ab, bitte um Hilfe bei der Erstattung",
        "pt": "O mesmo pagamento saiu duas vezes do meu cartão, preciso de ajuda com o reembolso",
    }),
    (2, "billing", "low", {
        "en": "Can I get a copy of my latest invoice for the last payment?",
        "es": "¿Puedo recibir una copia de mi última factura del último pago?",
        "fr": "Puis-je recevoir une copie de ma dernière facture pour le paiement ?",
        "de": "Kann ich eine Kopie meiner letzten Rechnung für die Zahlung bekommen?",
        "pt": "Posso receber uma cópia da minha última fatura do pagamento?",
    }),
    (3, "technical_support", "critical", {
        "en": "URGENT: the server is down and the app shows an error",
        "es": "URGENTE: el servidor está caído y la aplicación muestra un error",
        "fr": "URGENT : le serveur est en panne et l'application affiche une erreur",
        "de": "DRINGEND: der Server ist ausgefallen und die App zeigt einen Fehler",
        "pt": "URGENTE: o servidor está fora do ar e o aplicativo mostra um erro",
    }),
    (4, "technical_support", "medium", {
        "en": "How to restart the router when the connection keeps dropping?",
        "es": "¿Cómo reinicio el router cuando la conexión se corta?",
        "fr": "Comment redémarrer le routeur quand la connexion se coupe ?",
        "de": "Wie starte ich den Router neu, wenn die Verbindung abbricht?",
        "pt": "Como reinicio o roteador quando a conexão cai?",
    }),
    (5, "account", "medium", {
        "en": "Two profiles carry my name and I would like to merge them into one account",
        "es": "Hay dos perfiles con mi nombre y quiero unirlos en una sola cuenta",
        "fr": "Deux profils portent mon nom et je veux les réunir dans un seul compte",
        "de": "Zwei Profile tragen meinen Namen und sollen ein gemeinsames Konto werden",
        "pt": "Há dois perfis com o meu nome e quero juntá-los em uma só conta",
    }),
    (6, "account", "low", {
        "en": "Please change the password for my profile",
        "es": "Por favor cambien la contraseña de mi perfil",
        "fr": "Merci de changer le mot de passe de mon profil",
        "de": "Bitte ändern Sie das Passwort für mein Profil",
        "pt": "Por favor mudem a senha do meu perfil",
    }),
    (7, "general_inquiry", "low", {
        "en": "What are your opening hours on weekends?",
        "es": "¿Cuál es su horario los fines de semana?",
        "fr": "Quels sont vos horaires le week-end ?",
        "de": "Wie sind Ihre Öffnungszeiten am Wochenende?",
        "pt": "Qual é o horário de vocês nos fins de semana?",
    }),
    (8, "general_inquiry", "medium", {
        "en": "I have a question about your plans and prices",
        "es": "Tengo una pregunta sobre sus planes y precios",
        "fr": "J'ai une question sur vos offres et vos prix",
        "de": "Ich habe eine Frage zu Ihren Tarifen und Preisen",
        "pt": "Tenho uma pergunta sobre os planos e os preços",
    }),
    (9, "complaint", "high", {
        "en": "Your service is terrible and this is an important issue for me",
        "es": "Su servicio es terrible y esto es muy importante para mí",
        "fr": "Votre service est terrible et c'est important pour moi",
        "de": "Ihr Service ist schrecklich und das ist mir wichtig",
        "pt": "O serviço de vocês é terrível e isto é importante para mim",
    }),
    (10, "complaint", "critical", {
        "en": "This is an emergency, the product arrived broken",
        "es": "Es una emergencia, el producto llegó roto",
        "fr": "C'est une urgence, le produit est arrivé cassé",
        "de": "Das ist ein Notfall, das Produkt kam kaputt an",
        "pt": "É uma emergência, o produto chegou quebrado",
    }),
    (11, "feedback", "low", {
        "en": "Thanks for the quick reply, the new design is great",
        "es": "Gracias por la respuesta rápida, el nuevo diseño es genial",
        "fr": "Merci pour la réponse rapide, le nouveau design est super",
        "de": "Danke für die schnelle Antwort, das neue Design ist toll",
        "pt": "Obrigado pela resposta rápida, o novo design é ótimo",
    }),
    (12, "feedback", "medium", {
        "en": "I would like to suggest a dark mode for the app",
        "es": "Me gustaría sugerir un modo oscuro para la aplicación",
        "fr": "Je voudrais suggérer un mode sombre pour l'application",
        "de": "Ich möchte einen dunklen Modus für die App vorschlagen",
        "pt": "Gostaria de sugerir um modo escuro para o aplicativo",
    }),
]

_LONG = ("My order history page is slow and the export button does nothing "
         "after I pick a date range. ") * 7

# Edge rows: (intent, urgency, text); all English.
EDGE_ROWS = [
    ("technical_support", "high",
     "Check https://status.example.com/incident?id=7 and www.example.org/help-center for details"),
    ("account", "critical",
     "Write to jane.doe@example.com, it is urgent!"),
    ("general_inquiry", "low", "   \t  "),
    ("billing", "medium", "I was billed 100% more than last month and need a fix"),
    ("technical_support", "high",
     "Too   many\tspaces\n\nhere,  please   HELP with the error "),
    ("complaint", "critical", "EMERGENCY!!! Everything is BROKEN"),
    ("general_inquiry", "low", ""),
    ("technical_support", "medium", _LONG),
]


def phrase_rows() -> list[tuple]:
    """(phrase_id, concept_id, text, intent, urgency, language), ids from 0."""
    rows: list[tuple] = []
    for concept_id, intent, urgency, texts in CONCEPTS:
        for lang in LANGS:
            rows.append((len(rows), concept_id, texts[lang], intent, urgency, lang))
    for i, (intent, urgency, text) in enumerate(EDGE_ROWS):
        rows.append((len(rows), 100 + i, text, intent, urgency, "en"))
    return rows


def translation_rows() -> list[tuple]:
    """(source_text, target_language, text) from the parallel concepts."""
    rows = []
    for _, _, _, texts in CONCEPTS:
        for lang in LANGS[1:]:
            rows.append((texts["en"], lang, texts[lang]))
    return rows


# Function words per language for the vote backend (own lists).
FUNCTION_WORDS = {
    "en": ["the", "and", "is", "my", "to", "of", "for", "i", "it", "this", "on",
           "in", "with", "your", "me", "are", "what", "can", "have", "was", "an",
           "by", "at", "be", "that", "as"],
    "es": ["el", "los", "las", "del", "y", "que", "un", "una", "mi", "con",
           "por", "para", "es", "está", "se", "su", "al", "lo", "cómo", "muy",
           "esto", "sobre"],
    "fr": ["le", "les", "des", "du", "et", "est", "une", "mon", "ma", "pour",
           "qui", "je", "pas", "sur", "avec", "vous", "vos", "ce", "au", "c",
           "l", "j", "m", "quand"],
    "de": ["der", "die", "das", "und", "ist", "ein", "eine", "einen", "mein",
           "meine", "mit", "für", "nicht", "ich", "zu", "den", "dem", "von",
           "sie", "bitte", "bei", "auf", "wie", "am"],
    "pt": ["o", "os", "as", "do", "da", "e", "é", "um", "uma", "meu", "minha",
           "com", "não", "em", "no", "na", "pela", "dos", "das", "vocês", "isto",
           "mim"],
    "it": ["il", "gli", "della", "delle", "dei", "che", "sono", "è", "nel", "nella",
           "mio", "mia", "anche", "questo", "questa", "perché", "ho", "di", "più",
           "non", "alla", "essere", "vorrei"],
    "nl": ["het", "een", "van", "niet", "ik", "mijn", "voor", "zijn", "deze", "naar",
           "maar", "ook", "aan", "heb", "geen", "hoe", "uw", "wij", "wordt", "kan"],
    "pl": ["nie", "jest", "się", "że", "jak", "mój", "moje", "dla", "czy", "proszę",
           "przez", "ale", "są", "jestem", "mam", "który", "którą", "na", "kiedy"],
    "vi": ["là", "và", "của", "có", "không", "tôi", "cho", "với", "những", "được",
           "này", "một", "các", "để", "người", "bị", "khi", "đã"],
    "id": ["yang", "dan", "saya", "tidak", "untuk", "dengan", "ini", "itu", "dari",
           "pada", "adalah", "akan", "sudah", "bisa", "anda", "karena", "ke"],
    "tr": ["ve", "bir", "bu", "için", "ile", "değil", "benim", "çok", "ama", "nasıl",
           "daha", "gibi", "ne", "var", "olarak", "lütfen", "zaman"],
    "sv": ["och", "är", "jag", "inte", "att", "som", "på", "av", "för", "ett", "till",
           "mitt", "hur", "vi", "när", "skulle", "ert", "eftersom"],
    "da": ["og", "er", "jeg", "ikke", "af", "et", "mit", "hvordan", "fra", "hvad",
           "eller", "når", "også", "blev", "vil", "gerne", "jeres", "fordi"],
}

# Languages of one script of their own: settled by the script of their letters.
SCRIPT_LANGUAGES = ["zh", "ja", "ko", "ar", "hi", "th", "ru"]

# Intent lexicon: (label, token, weight).  Own list, five languages.
INTENT_LEXICON = [
    ("billing", t, w) for t, w in [
        ("charged", 2), ("refund", 2), ("invoice", 2), ("payment", 2),
        ("billed", 2), ("cobraron", 2), ("reembolso", 2), ("factura", 2),
        ("pago", 2), ("facturé", 2), ("remboursement", 2), ("facture", 2),
        ("paiement", 2), ("berechnet", 2), ("erstattung", 2), ("rechnung", 2),
        ("zahlung", 2), ("cobrado", 2), ("fatura", 2), ("pagamento", 2),
        ("prices", 1), ("precios", 1), ("prix", 1), ("preisen", 1), ("preços", 1),
    ]
] + [
    ("technical_support", t, w) for t, w in [
        ("server", 2), ("error", 2), ("router", 2), ("connection", 2),
        ("app", 1), ("servidor", 2), ("aplicación", 1), ("conexión", 2),
        ("serveur", 2), ("erreur", 2), ("routeur", 2), ("connexion", 2),
        ("application", 1), ("fehler", 2), ("verbindung", 2), ("erro", 2),
        ("roteador", 2), ("conexão", 2), ("aplicativo", 1), ("export", 1),
        ("slow", 1),
    ]
] + [
    ("account", t, w) for t, w in [
        ("account", 2), ("password", 2), ("email", 1), ("profile", 2),
        ("cuenta", 2), ("contraseña", 2), ("correo", 1), ("perfil", 2),
        ("compte", 2), ("passe", 2), ("mail", 1), ("profil", 2), ("konto", 2),
        ("passwort", 2), ("mailadresse", 1), ("conta", 2), ("senha", 2),
    ]
] + [
    ("general_inquiry", t, w) for t, w in [
        ("hours", 2), ("question", 1), ("plans", 1), ("weekends", 1),
        ("horario", 2), ("pregunta", 1), ("planes", 1), ("horaires", 2),
        ("offres", 1), ("öffnungszeiten", 2), ("frage", 1), ("tarifen", 1),
        ("horário", 2), ("pergunta", 1), ("planos", 1), ("details", 1),
    ]
] + [
    ("complaint", t, w) for t, w in [
        ("terrible", 2), ("broken", 2), ("complaint", 2), ("service", 1),
        ("terrível", 2), ("roto", 2), ("servicio", 1), ("cassé", 2),
        ("schrecklich", 2), ("kaputt", 2), ("quebrado", 2), ("serviço", 1),
    ]
] + [
    ("feedback", t, w) for t, w in [
        ("thanks", 2), ("great", 2), ("suggest", 2), ("design", 1),
        ("gracias", 2), ("genial", 2), ("sugerir", 2), ("diseño", 1),
        ("merci", 1), ("super", 2), ("suggérer", 2), ("danke", 2), ("toll", 2),
        ("vorschlagen", 2), ("obrigado", 2), ("ótimo", 2),
    ]
]

# Per-language sample sentences for the token-overlap detector.
OVERLAP_SAMPLES = {
    "en": "the library behind the old harbour opens at nine and its garden closes at dusk",
    "es": "el panel de la aplicación muestra un error en rojo durante la tormenta",
    "fr": "le tableau de bord de l'application affiche une erreur pendant l'orage",
    "de": "der kleine bildschirm der app zeigt einen fehler und das gerät bleibt stumm",
    "pt": "o painel do aplicativo mostra um erro e o sino da igreja toca tarde",
}

# Sample texts for the trigram profile of the languages without a phrase table.
PROFILE_SAMPLES = {
    "it": "Buongiorno, non riesco ad accedere al mio conto perché la password non funziona più. Vorrei sapere "
          "quando arriverà il mio ordine e come posso ottenere il rimborso della fattura che ho pagato due volte.",
    "nl": "Goedemiddag, ik kan niet meer inloggen op mijn rekening omdat het wachtwoord niet werkt. Graag zou ik "
          "willen weten wanneer mijn bestelling wordt bezorgd en hoe ik het geld van de dubbele factuur terugkrijg.",
    "pl": "Dzień dobry, nie mogę zalogować się na swoje konto, ponieważ hasło nie działa. Chciałbym wiedzieć, kiedy "
          "otrzymam zamówienie i jak mogę uzyskać zwrot pieniędzy za fakturę, którą zapłaciłem dwa razy.",
    "vi": "Xin chào, tôi không thể đăng nhập vào tài khoản của mình vì mật khẩu không hoạt động. Tôi muốn biết khi "
          "nào đơn hàng được giao và làm thế nào để được hoàn tiền cho hóa đơn đã thanh toán hai lần.",
    "id": "Selamat siang, saya tidak bisa masuk ke akun saya karena kata sandi tidak berfungsi. Saya ingin tahu kapan "
          "pesanan akan dikirim dan bagaimana cara mendapatkan pengembalian uang untuk tagihan yang sudah dibayar.",
    "tr": "Merhaba, şifrem çalışmadığı için hesabıma giriş yapamıyorum. Siparişimin ne zaman teslim edileceğini ve "
          "iki kez ödediğim fatura için paramı nasıl geri alabileceğimi öğrenmek istiyorum.",
    "sv": "Hej, jag kan inte logga in på mitt konto eftersom lösenordet inte fungerar längre. Jag skulle vilja veta "
          "när min beställning kommer och hur jag får tillbaka pengarna för fakturan som jag har betalat två gånger.",
    "da": "Goddag, jeg kan ikke logge ind på min konto, fordi adgangskoden ikke virker længere. Jeg vil gerne vide, "
          "hvornår min bestilling bliver leveret, og hvordan jeg får pengene tilbage for den regning.",
}

# Short phrases for the phrase translator: English, then es, fr, de, pt.
PHRASES = [
    ("check", "revise", "vérifiez", "prüfen Sie", "verifique"),
    ("for details", "para más detalles", "pour plus de détails", "für Einzelheiten", "para mais detalhes"),
    ("and", "y", "et", "und", "e"),
    ("write to", "escriba a", "écrivez à", "schreiben Sie an", "escreva para"),
    ("it is", "es", "c'est", "es ist", "é"),
    ("it is urgent", "es urgente", "c'est urgent", "es ist dringend", "é urgente"),
    ("i was billed", "me cobraron", "on m'a facturé", "mir wurde berechnet", "fui cobrado"),
    ("more than", "más que", "plus que", "mehr als", "mais do que"),
    ("last month", "el mes pasado", "le mois dernier", "im letzten Monat", "no mês passado"),
    ("need a fix", "necesito una solución", "j'ai besoin d'une solution", "brauche eine Lösung", "preciso de uma solução"),
    ("here", "aquí", "ici", "hier", "aqui"),
    ("please", "por favor", "s'il vous plaît", "bitte", "por favor"),
    ("help", "ayuda", "aide", "Hilfe", "ajuda"),
    ("with", "con", "avec", "mit", "com"),
    ("the error", "el error", "l'erreur", "dem Fehler", "o erro"),
    ("too many", "demasiados", "trop de", "zu viele", "demasiados"),
    ("spaces", "espacios", "espaces", "Leerzeichen", "espaços"),
    ("emergency", "emergencia", "urgence", "Notfall", "emergência"),
    ("everything", "todo", "tout", "alles", "tudo"),
    ("is broken", "está roto", "est cassé", "ist kaputt", "está quebrado"),
    ("my order history page", "mi página de pedidos", "ma page de commandes", "meine Bestellübersicht", "minha página de pedidos"),
    ("is slow", "es lenta", "est lente", "ist langsam", "está lenta"),
    ("the export button", "el botón de exportar", "le bouton d'export", "der Exportknopf", "o botão de exportar"),
    ("does nothing", "no hace nada", "ne fait rien", "tut nichts", "não faz nada"),
    ("after i pick", "después de elegir", "après avoir choisi", "nachdem ich wähle", "depois de escolher"),
    ("a date range", "un rango de fechas", "une période", "einen Zeitraum", "um intervalo de datas"),
]


def phrase_pairs() -> list[tuple]:
    """(source_text, target_language, text) of the short phrases and the parallel sentences."""
    return [(p[0], lang, p[1 + i]) for p in PHRASES for i, lang in enumerate(LANGS[1:])] + translation_rows()
