"""Ordinary texts that are not from the tables: in the four learned languages, and in others."""

LEARNED = {
    "en": [
        "The city council voted on Tuesday to repair the old stone bridge before winter, after engineers warned that heavy lorries could damage its arches. Traffic will use the northern road until spring.",
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "Mix the flour with a pinch of salt, rub in the butter, and add just enough cold water to bring the dough together. Let it rest for half an hour, then roll it out thinly and bake it until golden.",
        "Our train left early, so we missed it.",
        "Scientists measured how quickly the glacier moved during the past decade. Their instruments, buried deep in the ice, showed that it slid almost twice as far each summer as it had when observations began, and that meltwater was the main reason.",
        "She opened the letter slowly, read it twice, and put it back in its envelope without saying a word. Nobody at the table asked what it said, although everyone wanted to know.",
        "Please restart the computer after installing the update. If the screen stays black for more than five minutes, hold down the power button and try again.",
    ],
    "de": [
        "Der Stadtrat beschloss am Dienstag, die alte Steinbrücke noch vor dem Winter zu reparieren, nachdem Ingenieure gewarnt hatten, dass schwere Lastwagen die Bögen beschädigen könnten. Bis zum Frühling wird der Verkehr umgeleitet.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
        "Das Mehl mit einer Prise Salz mischen, die Butter einarbeiten und gerade so viel kaltes Wasser zugeben, dass ein Teig entsteht. Eine halbe Stunde ruhen lassen, dann dünn ausrollen und goldbraun backen.",
        "Unser Zug fuhr zu früh ab, deshalb haben wir ihn verpasst.",
        "Sie öffnete den Brief langsam, las ihn zweimal und steckte ihn wieder in den Umschlag, ohne ein Wort zu sagen. Niemand am Tisch fragte, was darin stand, obwohl es alle wissen wollten.",
    ],
    "fr": [
        "Le conseil municipal a décidé mardi de réparer le vieux pont de pierre avant l'hiver, après que des ingénieurs ont averti que les camions pourraient endommager ses arches. La circulation passera par la route du nord jusqu'au printemps.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "Mélangez la farine avec une pincée de sel, incorporez le beurre et ajoutez juste assez d'eau froide pour former une pâte. Laissez reposer une demi-heure, puis étalez finement et faites cuire jusqu'à ce qu'elle soit dorée.",
        "Notre train est parti trop tôt, nous l'avons donc manqué.",
        "Elle ouvrit lentement la lettre, la lut deux fois et la remit dans son enveloppe sans dire un mot. Personne à table ne demanda ce qu'elle contenait, bien que tout le monde voulût le savoir.",
    ],
    "es": [
        "El ayuntamiento decidió el martes reparar el viejo puente de piedra antes del invierno, después de que los ingenieros advirtieran que los camiones pesados podrían dañar sus arcos. El tráfico usará la carretera del norte hasta la primavera.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "Mezcle la harina con una pizca de sal, añada la mantequilla y la cantidad justa de agua fría para formar una masa. Déjela reposar media hora, luego estírela hasta que quede fina y hornéela hasta que esté dorada.",
        "Nuestro tren salió demasiado temprano, así que lo perdimos.",
        "Abrió la carta despacio, la leyó dos veces y la volvió a meter en el sobre sin decir una palabra. Nadie en la mesa preguntó qué decía, aunque todos querían saberlo.",
    ],
}

OTHER = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "zu": "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza futhi kufanele baphathane ngomoya wobunye.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
}

#: Written after the share of the quantile was chosen.
LATER = {
    "en": ["The museum keeps its oldest maps in a cool, dark room, and visitors may look at copies in the reading hall upstairs. Appointments are needed only at weekends.", "If it rains tomorrow, the children will paint indoors and the picnic will be moved to Sunday afternoon."],
    "de": ["Das Museum bewahrt seine ältesten Karten in einem kühlen, dunklen Raum auf, und Besucher können im Lesesaal Kopien ansehen. Nur am Wochenende ist eine Anmeldung nötig.", "Wenn es morgen regnet, malen die Kinder drinnen, und das Picknick wird auf Sonntag verschoben."],
    "fr": ["Le musée conserve ses plus anciennes cartes dans une salle fraîche et sombre, et les visiteurs peuvent en regarder des copies dans la salle de lecture. Un rendez-vous n'est nécessaire que le week-end.", "S'il pleut demain, les enfants peindront à l'intérieur et le pique-nique sera reporté à dimanche."],
    "es": ["El museo guarda sus mapas más antiguos en una sala fresca y oscura, y los visitantes pueden mirar copias en la sala de lectura. Solo hace falta cita los fines de semana.", "Si mañana llueve, los niños pintarán dentro y la merienda se pasará al domingo por la tarde."],
}
