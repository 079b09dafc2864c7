"""Word lists and patterns that decide results."""

# Emotion words.
EMOTIONS = {
    "joy": ["счастье", "радость", "восторг", "ликование", "веселье", "улыбка", "смех", "наслаждение", "happy", "joy", "delighted", "excited", "pleasure", "smile", "laugh", "enjoy"],
    "sadness": ["грусть", "печаль", "тоска", "уныние", "скорбь", "слезы", "горе", "сожаление", "sad", "sorrow", "grief", "depressed", "unhappy", "tears", "regret", "upset"],
    "anger": ["гнев", "злость", "ярость", "раздражение", "возмущение", "ненависть", "бешенство", "angry", "furious", "rage", "irritated", "annoyed", "hate", "mad", "outraged"],
    "fear": ["страх", "ужас", "тревога", "опасение", "паника", "испуг", "боязнь", "фобия", "fear", "terror", "anxiety", "worry", "panic", "scared", "frightened", "dread"],
    "surprise": ["удивление", "изумление", "шок", "неожиданность", "поразительно", "surprise", "astonishment", "amazement", "shock", "unexpected", "wow", "astonished"],
}

# Calls to action, as patterns over lower-case text.
CTA_PATTERNS = [
    r"купи[а-я]*\s+сейчас", r"заказ[а-я]*\s+сейчас", r"оформи[а-я]*\s+заказ", r"получи[а-я]*\s+сейчас", r"регистрир[а-я]*\s+сейчас", r"подпис[а-я]*\s+сейчас",
    r"начни[а-я]*\s+сейчас", r"попроб[а-я]*\s+бесплатно", r"скач[а-я]*\s+сейчас", r"забронир[а-я]*\s+сейчас", r"записа[а-я]*\s+сейчас", r"присоедин[а-я]*\s+сейчас",
    r"узнай[а-я]*\s+больше", r"buy\s+now", r"order\s+now", r"get\s+started", r"sign\s+up", r"register\s+now", r"download\s+now", r"subscribe\s+now", r"try\s+for\s+free",
    r"book\s+now", r"join\s+now", r"learn\s+more",
]

# What makes a call to action press.
CTA_TRIGGERS = {
    "urgency": ["сейчас", "немедленно", "сегодня", "до конца", "успей", "ограниченно", "срочно", "now", "today", "immediately", "limited", "hurry", "urgent", "deadline"],
    "scarcity": ["ограниченно", "только", "осталось", "эксклюзивно", "редкий", "последний", "limited", "only", "exclusive", "rare", "last chance", "few left"],
    "curiosity": ["узнай", "открой", "раскрой", "секрет", "интересно", "любопытно", "discover", "secret", "revealed", "find out", "interesting", "curiosity"],
    "value": ["бесплатно", "скидка", "выгодно", "экономия", "прибыль", "преимущество", "free", "discount", "save", "profit", "benefit", "advantage", "value"],
    "social_proof": ["популярный", "рекомендуют", "проверенный", "одобренный", "доверяют", "popular", "recommended", "trusted", "approved", "bestseller", "trending"],
    "fear_of_missing_out": ["не упусти", "не пропусти", "шанс", "однажды", "уникальный", "don't miss", "chance", "opportunity", "once", "unique", "limited time"],
}

# Form kinds by indicators in id and class, in order of precedence.
FORM_INDICATORS = {
    "search": ["search", "find", "query", "buscar", "поиск", "recherche"],
    "login": ["login", "signin", "log-in", "sign-in", "вход", "connexion"],
    "register": ["register", "signup", "sign-up", "create-account", "регистрация", "inscription"],
    "contact": ["contact", "feedback", "message", "контакт", "связаться", "contact-us", "contact_us"],
    "newsletter": ["newsletter", "subscribe", "подписаться", "подписка", "abonnement"],
    "checkout": ["checkout", "payment", "оплата", "paiement", "cart"],
}

# Navigation by indicators in id and class.
NAV_INDICATORS = ["menu", "nav", "navigation", "navbar", "main-menu", "header-menu", "top-menu", "навигация", "меню"]

# Social platforms by a pattern anywhere in a link, in order.
SOCIAL = {
    r"facebook\.com": "facebook", r"twitter\.com": "twitter", r"instagram\.com": "instagram", r"linkedin\.com": "linkedin", r"youtube\.com": "youtube", r"pinterest\.com": "pinterest",
    r"tiktok\.com": "tiktok", r"snapchat\.com": "snapchat", r"t\.me": "telegram", r"reddit\.com": "reddit", r"github\.com": "github", r"medium\.com": "medium", r"vk\.com": "vk",
    r"weibo\.com": "weibo", r"tumblr\.com": "tumblr", r"flickr\.com": "flickr", r"whatsapp\.com": "whatsapp", r"telegram\.org": "telegram", r"discord\.gg": "discord",
}

# Marks of pages that need a browser.
DYNAMIC = [
    r"ng-app", r"react-app", r"data-vue", r"ember-application", r"<nuxt", r"__NEXT_DATA__", r"ng-controller", r"v-if|v-for|v-model|v-on",
    r"\.load\(", r"\.ajax\(", r"fetch\(", r"new XMLHttpRequest\(\)", r"axios",
    r'class="[^"]*loading[^"]*"', r'id="[^"]*loading[^"]*"', r"skeleton|placeholder|lazy-load",
]

#: A sentiment lexicon of our own: English, German, French, Spanish, Russian.
POSITIVE = (
    "admire amazing appealing awesome beautiful best better brilliant charming cheerful comfortable confident delicious delight delightful easy effective efficient elegant enjoyable excellent exciting "
    "fantastic fast favorite flawless fresh friendly fun generous genuine glad good gorgeous grateful great happy healthy helpful honest impressive improved incredible inspiring joyful kind love lovely lucky "
    "nice outstanding perfect pleasant pleased positive powerful recommend reliable remarkable safe satisfied smooth strong success successful superb sweet thanks trusted useful valuable warm win wonderful worthy "
    "angenehm ausgezeichnet beste besser einfach erfolgreich freundlich froh großartig gut hervorragend hilfreich liebe nützlich perfekt schön sicher toll wunderbar zufrieden "
    "agréable beau bien bon bonheur bonne excellente facile formidable génial heureux magnifique meilleur merveilleux parfait ravi réussi sympa utile "
    "agradable alegre amable bueno buena encantador estupendo fácil feliz genial hermoso increíble maravilloso mejor perfecto útil "
    "отлично прекрасно хорошо лучший люблю замечательно красивый полезный радостный удобный успешный"
).split()
NEGATIVE = (
    "abuse afraid alarming angry annoying anxious ashamed awful bad bitter boring broken clumsy complain confusing corrupt cruel damage dangerous dead defective dirty disappointed disappointing disaster dreadful "
    "dull error evil fail failed failure false faulty fear frustrating guilty harmful hate horrible hostile idiot inferior insult lazy lie loser lost mad mediocre mess miserable mistake nasty negative nightmare "
    "pain painful pathetic poor problem ridiculous rude sad scam scary selfish shame sick slow stupid terrible trash ugly unfair unhappy unreliable useless violent weak worse worst worthless wrong "
    "ärgerlich dumm enttäuscht falsch fehler furchtbar gefährlich hass hässlich kaputt langweilig schlecht schlimm schmutzig schrecklich schwach traurig "
    "affreux déçu désagréable difficile ennuyeux erreur faible haine horrible laid mauvais mauvaise méchant nul pire sale triste "
    "aburrido feo difícil lento malo mala miedo odio peligroso peor pésimo sucio terrible tonto "
    "плохо ужасно ненавижу худший грустно медленно опасный ошибка проблема скучно страшно"
).split()
#: The word after one of these means the opposite.
NEGATIONS = "not no never without hardly isn don doesn didn wasn won nicht kein keine nie ohne pas jamais sans ni nunca sin tampoco не ни нет без никогда".split()

#: Stop words of our own choice for the languages of the corpus.
STOPWORDS = (
    "a an the and or but if of to in on for with as by at from is are was were be been being it its this that these those he she they we you i not no so do does did have has had will would can could "
    "und der die das den dem des ein eine einer ist sind war mit von zu im in auf für nicht sich auch es er sie wir ihr "
    "le la les un une des de du et ou est sont dans pour par sur avec qui que ne pas ce cette il elle nous vous "
    "el los las una unos y o es son en por con para del al que no se su lo como "
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по"
).split()

#: Stop words by language, of our own choice too; any other language takes the list above.
STOPWORDS_BY_LANGUAGE = {
    "en": "a an the and or but if of to in on for with as by at from is are was were be been it its this that he she they we you i not no so do does did have has had will would can could".split(),
    "de": "und der die das den dem des ein eine einer ist sind war mit von zu im in auf für nicht sich auch es er sie wir ihr".split(),
    "fr": "le la les un une des de du et ou est sont dans pour par sur avec qui que ne pas ce cette il elle nous vous".split(),
    "es": "el la los las un una unos de y o en es son por con para del al que no se su lo como".split(),
    "it": "il lo la i gli le un una di a da in con su per tra fra e o è sono che non si come del della".split(),
    "nl": "de het een en of van in op te dat is zijn was met voor niet aan er ook door bij".split(),
    "pt": "o a os as um uma de do da dos das em no na e ou é são que não se por com para como".split(),
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по".split(),
}
