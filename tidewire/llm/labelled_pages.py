"""Labelled pages the main-body model starts from.

The lines are written for this purpose, from how news sites in general word
their stories and their furniture; none is taken from any table (a test holds
every line against the articles). ``pages`` puts them together in the order
such pages have, as plain lines, as flat markup and as nested elements, and
labels each line: True in the main body, False in the furniture. A line's
number in its list decides its part (even or odd), so a model can be tested on
pages none of whose lines it has met.
"""

from __future__ import annotations

import random

#: Pages put together from the lines below.
PAGES = 1200

_NAMES = {
    "en": ["Ashcombe", "Harlow Bay", "Redmere", "Calder", "Port Wynn", "Stanmoor", "Elkridge", "Tessaly", "Brackwater", "Dunholm"],
    "de": ["Altenried", "Bad Lorsen", "Grünfeld", "Weilach", "Hohenau", "Steinbek", "Oderwalde", "Rissen"],
    "fr": ["Montclar", "Sainte-Ravelle", "Beauvoir", "Port-Louvet", "Vallerey", "Champsec", "Orlemont"],
    "es": ["Villarreal de Olma", "Peñalta", "Santa Brisa", "Torremera", "Alcorán", "Valdesol"],
    "zh": ["临江市", "海宁湾", "青石县", "白鹭镇", "南浦", "云岭", "东塘区", "罗维恩"],
}
_PAPERS = {"en": ["The Daily Ledger", "Ashcombe Gazette", "Newsline 24"], "de": ["Weilacher Rundschau", "Der Tagesblick"], "fr": ["L'Observateur du Soir", "Gazette de Montclar"], "es": ["El Eco de Peñalta", "La Crónica Hoy"], "zh": ["临江晨报", "今日要闻网"]}

# Lines of the body. {p}: the place of the story, {q}: another one, {n}: a number.
BODY = {
    "en": {
        "head": ["Thousands march through {p} over school cuts", "{p} hospital to shed {n} jobs", "Storm leaves {p} without trains", "Police search lake near {p} for missing hiker", "Voters in {p} turn down new stadium", "Factory fire in {p} forces {n} from homes", "Why rents in {p} keep rising", "{p} mayor steps down after audit", "Scientists find rare orchid outside {p}", "Judge clears way for {p} tunnel"],
        "sub": ["How it started", "A divided town", "Calls for change", "‘We had no warning’", "What the figures show", "Mixed response in {p}", "Looking ahead", "Counting the cost", "Questions remain", "Growing pressure"],
        "para": [
            "More than {n} people gathered outside the town hall in {p} on Tuesday evening, according to police, and many of them stayed until after midnight.",
            "The company, which has been based in {p} since 1974, said it would consult staff before making a final decision in the spring.",
            "Local officials told reporters they had not been informed of the plan. They want a meeting with the transport secretary this week.",
            "“My children learned to swim here,” said Anna Keller, 43, who lives two streets away. “I can't imagine {p} without it.”",
            "The judge ruled that the evidence had been gathered properly, and he dismissed the appeal.",
            "It is the third time in a decade that the river has burst its banks, and insurers expect claims worth {n} million.",
            "Doctors at the clinic in {p} had warned for months that there were too few beds.",
            "Firefighters worked through the night to stop the flames from reaching a nearby school. No injuries were reported.",
            "In a statement, the ministry said that the figures were preliminary and would be revised in June. Opposition leaders called the explanation absurd.",
            "He was born in {q}, studied law, and moved to {p} when he was 29.",
            "The new line will cut the journey between {p} and {q} to {n} minutes, but critics say that it comes years too late.",
            "Researchers compared samples from {n} households and found that levels had fallen by almost half since the ban took effect.",
            "Asked whether she would stand again, the mayor smiled and said that it was too early to tell.",
            "Trains were running again by noon on Wednesday, although passengers were told to expect delays for the rest of the week.",
            "Prices rose 2.4% in May, the fastest pace since 2019. Economists polled by a local bank had expected 2.1%.",
            "The two sides are due to meet again on Friday in {q}.",
            "Nobody has been arrested. Detectives have asked anyone who was in the area between 9 p.m. and midnight to come forward.",
            "For shop owners like Farid Aziz, the closure came at the worst possible moment: he had just hired {n} people for the summer season.",
            "She added: “We will look at every option, and we will be honest about what each one costs.”",
            "Under the agreement, farmers may draw water for only four days a week until the reservoir near {p} has recovered.",
        ],
        "quote": ["“I have never seen anything like it,” said a neighbour.", "“This is about fairness for people in {p}.”", "“It took minutes. Then the lights went out.”", "'They promised us a bridge and we got a ferry'", "“Ask the families in {p} how they feel.”", "“Enough is enough,” one resident shouted from the gallery."],
        "item": ["{p} High Street: closed in both directions", "Wednesday: rain, clearing later", "{n} volunteers from {p}", "Free parking near the station in {p}", "Mains water to {n} homes", "East {p}: power restored"],
    },
    "de": {
        "head": ["Tausende protestieren in {p} gegen Kürzungen", "Klinik {p} streicht {n} Stellen", "Sturm stoppt Züge rund um {p}", "Polizei sucht Vermissten bei {p}", "{p} stimmt gegen neues Stadion", "Warum Mieten in {p} weiter steigen"],
        "sub": ["Wie alles begann", "Geteilte Meinungen", "Offene Fragen", "Was die Zahlen zeigen", "Blick nach vorn", "Druck auf {p} wächst"],
        "para": [
            "Mehr als {n} Menschen versammelten sich am Dienstagabend vor dem Rathaus in {p}, viele blieben nach Angaben der Polizei bis nach Mitternacht.",
            "Das Unternehmen, das seit 1974 in {p} sitzt, will vor einer Entscheidung mit der Belegschaft sprechen.",
            "„Meine Kinder haben hier schwimmen gelernt“, sagt Anna Keller, die zwei Straßen weiter wohnt. „Ohne das Bad kann ich mir {p} nicht vorstellen.“",
            "Die Feuerwehr war die ganze Nacht im Einsatz, um eine Schule zu schützen. Verletzt wurde niemand.",
            "Die neue Strecke verkürzt die Fahrt zwischen {p} und {q} auf {n} Minuten, doch Kritiker halten sie für verspätet.",
            "Forscher verglichen Proben aus {n} Haushalten und stellten fest, dass die Werte seit dem Verbot um fast die Hälfte gesunken sind.",
            "Am Mittwoch fuhren die Züge wieder, Reisende müssen aber mit Verspätungen rechnen.",
            "Die Gespräche sollen am Freitag in {q} weitergehen.",
            "Auf die Frage, ob sie noch einmal antrete, lächelte die Bürgermeisterin nur.",
            "Festgenommen wurde bisher niemand; die Ermittler bitten Zeugen, sich zu melden.",
        ],
        "quote": ["„So etwas habe ich noch nie gesehen“, sagt ein Nachbar.", "„Es geht um Gerechtigkeit für {p}.“", "„Jetzt reicht es“, rief eine Zuhörerin in {p}.", "„Uns wurde eine Brücke versprochen.“"],
        "item": ["Hauptstraße in {p}: in beiden Richtungen gesperrt", "Mittwoch: Regen, später sonnig", "{n} Freiwillige aus {p}", "Kostenlose Parkplätze am Bahnhof {p}"],
    },
    "fr": {
        "head": ["Des milliers de manifestants à {p} contre les coupes", "L'hôpital de {p} supprime {n} postes", "La tempête paralyse les trains de {p}", "À {p}, les loyers grimpent encore", "La maire de {p} quitte ses fonctions", "Une usine en feu près de {p}"],
        "sub": ["Une ville partagée", "Comment tout a commencé", "Des questions en suspens", "Ce que disent les chiffres", "L'avenir de {p}", "La pression monte"],
        "para": [
            "Plus de {n} personnes se sont rassemblées mardi soir devant la mairie de {p}, et beaucoup sont restées jusqu'après minuit, selon la police.",
            "L'entreprise, installée à {p} depuis 1974, consultera ses salariés avant de trancher au printemps.",
            "« Mes enfants ont appris à nager ici », raconte Anna Keller, qui habite à deux rues de là.",
            "Les pompiers ont lutté toute la nuit pour protéger une école voisine. Aucun blessé n'est à déplorer.",
            "La nouvelle ligne mettra {p} à {n} minutes de {q}, mais ses détracteurs estiment qu'elle arrive trop tard.",
            "Les chercheurs ont comparé les échantillons de {n} foyers et constaté une baisse de près de moitié depuis l'interdiction.",
            "Interrogée sur une nouvelle candidature, la maire a souri sans répondre.",
            "Les deux parties doivent se revoir vendredi à {q}.",
            "Personne n'a été arrêté ; les enquêteurs lancent un appel à témoins.",
            "Les trains circulaient de nouveau mercredi midi, avec des retards attendus toute la semaine.",
        ],
        "quote": ["« Je n'ai jamais vu ça », souffle un voisin.", "« C'est une question de justice pour {p}. »", "« Ça suffit », a crié une habitante de {p}.", "« On nous avait promis un pont. »"],
        "item": ["Grande rue de {p} : fermée dans les deux sens", "Mercredi : pluie puis éclaircies", "{n} bénévoles venus de {p}", "Parking gratuit à la gare de {p}"],
    },
    "es": {
        "head": ["Miles de personas marchan en {p} contra los recortes", "El hospital de {p} elimina {n} puestos", "El temporal deja sin trenes a {p}", "Los alquileres de {p} siguen subiendo", "Dimite la alcaldesa de {p}", "Arde una fábrica cerca de {p}"],
        "sub": ["Una ciudad dividida", "Cómo empezó todo", "Preguntas abiertas", "Lo que dicen los números", "El futuro de {p}", "Crece la presión"],
        "para": [
            "Más de {n} personas se reunieron el martes por la noche ante el ayuntamiento de {p}, y muchas se quedaron hasta pasada la medianoche.",
            "La empresa, con sede en {p} desde 1974, consultará a la plantilla antes de tomar una decisión en primavera.",
            "«Mis hijos aprendieron a nadar aquí», cuenta Ana Keller, que vive a dos calles.",
            "Los bomberos trabajaron toda la noche para proteger una escuela cercana. No hubo heridos.",
            "La nueva línea dejará el viaje entre {p} y {q} en {n} minutos, aunque sus críticos creen que llega tarde.",
            "Los investigadores compararon muestras de {n} hogares y vieron que los niveles habían bajado casi a la mitad.",
            "Preguntada por una nueva candidatura, la alcaldesa sonrió y no respondió.",
            "Las dos partes volverán a verse el viernes en {q}.",
            "No hay detenidos; la policía pide la colaboración de posibles testigos.",
            "Los trenes volvieron a circular el miércoles al mediodía, con retrasos previstos toda la semana.",
        ],
        "quote": ["«Nunca había visto nada igual», dice un vecino.", "«Es una cuestión de justicia para {p}».", "«Basta ya», gritó una vecina de {p}.", "«Nos prometieron un puente»."],
        "item": ["Calle Mayor de {p}: cortada en ambos sentidos", "Miércoles: lluvia y claros", "{n} voluntarios de {p}", "Aparcamiento gratuito en la estación de {p}"],
    },
    "zh": {
        "head": ["{p}数千人上街反对削减学校经费", "{p}医院将裁员{n}人", "暴风雨致{p}列车停运", "{p}房租为何一路上涨", "{p}市长在审计后辞职", "{p}附近工厂起火"],
        "sub": ["事情的起因", "意见不一", "仍待解答的问题", "数据说明了什么", "展望未来", "{p}面临的压力"],
        "para": [
            "警方表示，周二晚间有{n}多人聚集在{p}政府大楼外，许多人直到午夜之后才离开。",
            "这家自1974年起落户{p}的公司表示，将在明年春天作出决定之前征求员工的意见。",
            "“我的孩子就是在这里学会游泳的。”住在两条街外的凯勒女士说，“没有它的{p}我无法想象。”",
            "消防员整夜奋战，阻止火势蔓延到附近的一所学校。目前没有人员受伤的报告。",
            "新线路将把{p}到{q}的车程缩短到{n}分钟，但批评者认为它来得太晚。",
            "研究人员比较了{n}户家庭的样本，发现自禁令生效以来数值下降了将近一半。",
            "被问及是否会再次参选时，市长只是笑了笑。",
            "双方定于星期五在{q}再次会面。",
            "目前尚无人被捕，警方呼吁目击者提供线索。",
            "列车在周三中午恢复运行，但旅客整个星期都可能遇到延误。",
        ],
        "quote": ["“我从来没见过这样的场面。”一位邻居说。", "“这关系到{p}人的公平。”", "“够了！”一名{p}居民喊道。", "“他们答应给我们一座桥。”"],
        "item": ["{p}大街：双向封闭", "星期三：有雨，之后转晴", "来自{p}的{n}名志愿者", "{p}车站旁免费停车"],
    },
}
# Lines of the furniture. {s}: the paper.
FURNITURE = {
    "en": {
        "menu": ["UK|US|Culture|Lifestyle|Travel|Football|Puzzles|Log in", "Today|Local|National|Arts|Money|Tech|Health|Obituaries", "Skip to content|Sections|Subscribe now|Register", "Watch live|Listen|Schedules|Shop|Contact the newsroom"],
        "notice": ["We use cookies and similar tools to improve your experience, show you relevant ads and analyse our traffic. See our cookie policy.", "By clicking “Accept” you consent to the use of cookies on this website. Manage preferences", "You have reached your limit of free articles this month.", "This website uses cookies to ensure you get the best experience. Got it!", "Please enable JavaScript to view this page properly.", "{s} and selected third parties use trackers. You may withdraw consent whenever you like.", "Your browser is out of date; parts of this page may not work.", "We value your privacy. Options: accept, reject, learn more"],
        "by": ["By Martha Lindqvist, political editor", "Words by Tom Obi, pictures by Lena Faro", "Written by a staff writer of {s}", "Jane Moss | Senior reporter", "By our own correspondent", "{s} newsroom", "Edited by P. Grant", "Additional reporting by Sam Reyes"],
        "time": ["Tue 4 March 2025 09.12 GMT", "Posted 3 hours ago · 5 minute read", "First published on 12 May 2024, {h}:{m}", "March 9, 2025 at {h}:{m} EST", "Modified {d}/{o}/2025", "{h}:{m}, {d} June 2024"],
        "ad": ["ADVERTISEMENT - SCROLL TO CONTINUE READING", "Promoted content from our partners", "Ad", "Remove ads with a subscription", "Partner offer: save 20% today", "Article continues below"],
        "teaserhead": ["Recommended for you", "Editor's picks", "Read more on this story", "Trending now", "Top stories", "More like this", "Keep reading", "Don't miss"],
        "teaser": ["In pictures: carnival season in {q}", "Analysis: what {q} tells us about the economy", "Opinion | {q} deserves better", "Podcast: the week in {q}", "{q} coach resigns after defeat", "Explained: the new tax rules in {q}", "Quiz: how well do you know {q}?", "Five walks around {q}"],
        "share": ["Share on Facebook", "Tweet this article", "Share via WhatsApp, e-mail or link", "Save for later", "Like us on social media", "Copy URL | Print | Bookmark", "Share", "Follow {s} on Instagram and YouTube"],
        "letter": ["Subscribe to our newsletter to get the headlines in your inbox.", "Enter your email address to sign up for breaking news alerts.", "Support independent journalism: become a member of {s} from £1 a week.", "Get our app on iOS and Android", "Thank you for subscribing!", "Try {s} free for a month, cancel at any time.", "Join {n} subscribers and get the week in review.", "Turn on notifications"],
        "comment": ["View all {n} comments", "Leave a reply. Your email address will not be published.", "Have your say: post a comment below", "Report this comment", "Commenting has been turned off.", "Be the first to comment", "Sort by: newest, oldest, most liked", "Got a tip? Write to the newsroom"],
        "tags": ["Filed under: {p}, {c}, local government", "Related topics: {c} | {p}", "More about: {p} · {c}", "#{c} #{p}"],
        "legal": ["© 2024 {s} Ltd. All rights reserved.", "Copyright 2025 {s}. No part of this site may be reproduced without permission.", "{s} is not responsible for the content of external sites.", "This material may not be published, broadcast, rewritten or redistributed.", "Registered in England, company number 0{n}17. Registered office: 1 Mill Lane.", "Use of this site constitutes acceptance of our user agreement and privacy statement.", "Market data delayed by at least 15 minutes; for information only.", "© {s}, {o}/2025"],
        "footer": ["Complaints & corrections|Modern slavery statement|Work for us|Digital archive", "Privacy notice|Do not sell my information|Cookie settings|FAQ", "RSS|Site index|Licensing|Newsroom ethics", "Back to top|Facebook|Twitter|Instagram"],
    },
    "de": {
        "menu": ["Nachrichten|Lokales|Kultur|Reise|Fußball|Rätsel|Einloggen", "Zum Inhalt springen|Ressorts|Abo|Registrieren", "Panorama|Netzwelt|Gesundheit|Gesellschaft|Podcasts", "Live|Mediathek|Programm|Shop"],
        "notice": ["Wir verwenden Cookies, um Inhalte und Anzeigen zu personalisieren. Mehr dazu in der Datenschutzerklärung.", "Ihr Browser ist veraltet. Bitte aktualisieren Sie ihn.", "Mit Klick auf „Zustimmen“ willigen Sie in die Nutzung von Trackern ein.", "Sie haben das Limit kostenloser Artikel erreicht."],
        "by": ["Von Martha Lind, Berlin", "Ein Bericht unserer Mitarbeiterin", "Text: Tom Ober, Fotos: Lena Farn", "{s} Redaktion"],
        "time": ["4. März 2025, {h}:{m} Uhr", "Veröffentlicht vor 3 Stunden · 5 Minuten Lesedauer", "Erstellt am {d}.{o}.2024", "Geändert: {d}. Juni 2024"],
        "ad": ["WERBUNG", "Weiter nach der Werbung", "Angebot unseres Partners", "Werbefrei lesen mit dem Abo"],
        "teaserhead": ["Empfohlen für Sie", "Lesetipps der Redaktion", "Weitere Artikel", "Top-Themen"],
        "teaser": ["Bilderstrecke: Karneval in {q}", "Kommentar: {q} hat mehr verdient", "Trainer von {q} tritt zurück", "Quiz: Wie gut kennen Sie {q}?"],
        "share": ["Auf Facebook teilen", "Per WhatsApp oder E-Mail weiterleiten", "Merken", "Link in die Zwischenablage"],
        "letter": ["Abonnieren Sie unseren Newsletter mit den wichtigsten Nachrichten.", "Unterstützen Sie {s} mit einem Abo ab 1 Euro die Woche.", "Jetzt die App laden", "Geben Sie Ihre E-Mail-Adresse ein."],
        "comment": ["Alle {n} Kommentare anzeigen", "Schreiben Sie den ersten Kommentar", "Ihre Meinung ist gefragt: Diskutieren Sie mit", "Kommentar melden"],
        "tags": ["Mehr zum Thema: {p}, {c}", "Themen: {c} | {p}"],
        "legal": ["© 2024 {s} GmbH. Alle Rechte vorbehalten.", "Die Verwendung der Texte ist nur mit Genehmigung gestattet.", "{s} übernimmt keine Verantwortung für externe Inhalte.", "Kursdaten mindestens 15 Minuten verzögert."],
        "footer": ["AGB|Mediadaten|Jobs|Archiv", "Cookie-Einstellungen|Hilfe & FAQ|Verträge kündigen", "Nach oben|RSS|Newsletter"],
    },
    "fr": {
        "menu": ["Actualités|Culture|Voyage|Football|Jeux|Se connecter", "Aller au contenu|Rubriques|S'abonner|Créer un compte", "Santé|Société|Planète|Débats|Podcasts", "En direct|Replay|Programme TV|Boutique"],
        "notice": ["Nous utilisons des cookies pour personnaliser le contenu et analyser notre trafic. En savoir plus", "Votre navigateur n'est plus à jour.", "En cliquant sur « J'accepte », vous consentez au dépôt de traceurs.", "Vous avez lu tous vos articles gratuits du mois."],
        "by": ["Par Marthe Lindon, à Paris", "Texte : Tom Ober, photos : Léna Faure", "Notre envoyée spéciale", "{s} avec agences"],
        "time": ["Le 4 mars 2025 à {h} h {m}", "Publié il y a 3 heures · Temps de lecture : 5 minutes", "Modifié le {d} juin 2024", "Créé le {d}/{o}/2024"],
        "ad": ["PUBLICITÉ PARTENAIRE", "L'article continue ci-dessous", "Offre de notre partenaire", "Lisez sans publicité avec l'abonnement"],
        "teaserhead": ["Recommandé pour vous", "Le choix de la rédaction", "Voir aussi", "Tendances"],
        "teaser": ["En images : le carnaval de {q}", "Tribune : {q} mérite mieux", "L'entraîneur de {q} démissionne", "Quiz : connaissez-vous {q} ?"],
        "share": ["Partager sur Facebook", "Envoyer par WhatsApp ou e-mail", "Enregistrer l'article", "Copier l'adresse"],
        "letter": ["Inscrivez-vous à notre newsletter pour recevoir l'essentiel de l'actualité.", "Soutenez {s} : abonnez-vous dès 1 euro par semaine.", "Téléchargez notre application", "Saisissez votre adresse e-mail."],
        "comment": ["Voir les {n} commentaires", "Soyez le premier à commenter", "Donnez votre avis dans les commentaires", "Signaler ce commentaire"],
        "tags": ["Sujets : {p}, {c}", "Plus d'articles sur : {c} | {p}"],
        "legal": ["© 2024 {s} SAS. Tous droits de reproduction réservés.", "Toute diffusion sans autorisation est interdite.", "{s} n'est pas responsable des contenus externes.", "Cours de bourse différés d'au moins 15 minutes."],
        "footer": ["CGU|Annonceurs|Recrutement|Archives", "Paramétrer les cookies|FAQ|Résilier", "Haut de page|RSS|Facebook"],
    },
    "es": {
        "menu": ["Noticias|Cultura|Viajes|Fútbol|Pasatiempos|Iniciar sesión", "Ir al contenido|Secciones|Suscríbete|Regístrate", "Salud|Sociedad|Opinión|Gente|Podcasts", "En vivo|A la carta|Programación|Tienda"],
        "notice": ["Utilizamos cookies para personalizar el contenido y analizar nuestro tráfico. Más información", "Su navegador no está actualizado.", "Al pulsar «Aceptar» consiente el uso de rastreadores.", "Ha agotado sus artículos gratuitos de este mes."],
        "by": ["Por Marta Linde, Madrid", "Texto: Tomás Obi, fotos: Elena Faro", "Nuestra enviada especial", "{s} y agencias"],
        "time": ["4 de marzo de 2025, {h}:{m} h", "Publicado hace 3 horas · 5 minutos de lectura", "Modificado el {d} de junio de 2024", "Creado: {d}/{o}/2024"],
        "ad": ["PUBLICIDAD - SIGA LEYENDO", "El artículo continúa abajo", "Oferta de nuestro socio", "Lea sin anuncios con la suscripción"],
        "teaserhead": ["Recomendado para usted", "La selección del editor", "Otras noticias", "Tendencias"],
        "teaser": ["En fotos: el carnaval de {q}", "Opinión: {q} merece algo mejor", "Dimite el entrenador de {q}", "Test: ¿conoce usted {q}?"],
        "share": ["Compartir en Facebook", "Enviar por WhatsApp o correo", "Guardar para después", "Copiar dirección"],
        "letter": ["Suscríbase a nuestro boletín y reciba los titulares en su correo.", "Apoye a {s}: suscripción desde 1 euro a la semana.", "Descargue la aplicación", "Introduzca su correo electrónico."],
        "comment": ["Ver los {n} comentarios", "Sea el primero en comentar", "Díganos qué opina en los comentarios", "Denunciar comentario"],
        "tags": ["Archivado en: {p}, {c}", "Más sobre: {c} | {p}"],
        "legal": ["© 2024 {s} S.A. Reservados todos los derechos.", "Queda prohibida toda difusión sin autorización.", "{s} no se hace responsable de contenidos externos.", "Cotizaciones con al menos 15 minutos de retraso."],
        "footer": ["Condiciones|Anunciantes|Empleos|Hemeroteca", "Configurar cookies|Preguntas frecuentes|Darse de baja", "Volver arriba|RSS|Facebook"],
    },
    "zh": {
        "menu": ["新闻|本地|文化|旅游|足球|游戏|登陆账号", "跳到正文|栏目|立即订阅|注册", "社会|健康|评论|人物|音频", "直播间|回放|节目表|商城"],
        "notice": ["我们使用Cookie来改善您的浏览体验并分析流量，详情请见隐私政策。", "您的浏览器版本过低，请升级后访问。", "点击“同意”即表示您允许我们使用跟踪工具。", "您本月的免费文章已读完。"],
        "by": ["记者 王林 北京报道", "文/李平 图/陈光", "作者：特约撰稿人", "来源：{s}"],
        "time": ["2025年3月4日 {h}时{m}分", "3小时前发表 · 阅读需5分钟", "修改于{d}/{o}/2024", "2024-0{d1}-1{d1} {h}:{m}"],
        "ad": ["推广内容", "赞助商链接", "合作伙伴优惠：立减两成", "开通会员免广告"],
        "teaserhead": ["为您推荐", "编辑精选", "更多阅读", "今日热榜"],
        "teaser": ["组图：{q}的狂欢节", "评论：{q}值得更好", "{q}主教练辞职", "小测验：你了解{q}吗？"],
        "share": ["分享到微信", "转发到微博或发送给朋友", "收藏", "复制网址"],
        "letter": ["输入邮箱订阅每日要闻。", "支持{s}，每周只需一元即可成为会员。", "下载客户端", "打开消息通知，不错过突发新闻"],
        "comment": ["查看全部{n}条评论", "快来抢沙发", "说说您的看法，欢迎留言", "举报该评论"],
        "tags": ["关键词：{p} {c}", "更多相关：{c}、{p}"],
        "legal": ["© 2024 {s} 保留所有权利", "本网站内容未经授权禁止转载、摘编。", "{s}不对外部网站的内容负责。", "行情数据延迟至少15分钟，仅供参考。"],
        "footer": ["用户协议|广告刊例|诚聘英才|报刊检索", "缓存设置|常见问题|意见反馈", "回到顶部|客户端|微信"],
    },
}
_TOPICS = ["politics", "economy", "health", "science", "transport", "society", "education", "sport"]
_SEMANTIC = {"menu": "nav", "path": "nav", "notice": "aside", "head": "h1", "by": "span", "time": "time", "sub": "h2", "para": "p", "quote": "blockquote", "item": "li", "ad": "aside", "teaserhead": "h4", "teaser": "li", "share": "div", "letter": "aside", "comment": "div", "tags": "div", "legal": "footer", "footer": "footer"}
_BODY_ROLES = {"head", "sub", "para", "quote", "item"}


def lines_of(role_lists: dict) -> list[str]:
    """All lines of BODY or FURNITURE."""
    return [x for roles in role_lists.values() for lines in roles.values() for x in lines]


def pages(count: int = PAGES, seed: int = 5, part: int | None = None) -> list[dict]:
    """Pages as dicts with title, source_name, lines and labels; ``part`` (0 or 1) uses the lines of even or odd number only."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        lang = rng.choice(["en", "en", "de", "fr", "es", "zh"])
        p, q = rng.sample(_NAMES[lang], 2)
        s = rng.choice(_PAPERS[lang])

        def fill(t: str, p: str = p, q: str = q, s: str = s) -> str:
            return t.format(p=p, q=q, s=s, n=rng.randint(2, 990), h=f"{rng.randint(0, 23):02d}", m=f"{rng.randint(0, 59):02d}", d=rng.randint(1, 28), d1=rng.randint(1, 9), o=rng.randint(1, 12), c=rng.choice(_TOPICS))

        def pick(role: str, p: str = p, q: str = q, lang: str = lang) -> str:
            lines = (BODY if role in _BODY_ROLES else FURNITURE)[lang][role]
            return fill(rng.choice(lines if part is None else lines[part::2]), p, q)

        made: list[tuple[str, str, bool]] = []

        def add(role: str, text: str | None = None) -> None:
            made.append((role, pick(role) if text is None else text, role in _BODY_ROLES))

        def bar(role: str) -> None:
            items = pick(role).split("|")
            if rng.random() < 0.5:
                add(role, rng.choice([" | ", " · ", " > ", "  "]).join(items))
            else:
                for x in items:
                    add(role, x)

        def teaser() -> None:
            other = rng.choice([x for x in _NAMES[lang] if x not in (p, q)])
            add("teaser", pick("teaser", q=other) if rng.random() < 0.6 else pick("head", p=other))

        title = pick("head")
        if rng.random() < 0.6:
            bar("menu")
        if rng.random() < 0.3:
            add("path", f"{rng.choice(_TOPICS)} {rng.choice(['>', '/', '»'])} {p}")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            add("notice")
        if rng.random() < 0.75:
            add("head", title)
        for role in ("by", "time"):
            if rng.random() < 0.5:
                add(role)
        for _ in range(rng.randint(1, 8)):
            r = rng.random()
            if r < 0.18:
                add("sub")
            elif r < 0.28:
                add("quote")
            elif r < 0.38:
                for _ in range(rng.randint(2, 5)):
                    add("item")
            elif r < 0.55:
                role = rng.choice(["ad", "letter", "share", "teaser", "ad", "comment", "notice"])
                teaser() if role == "teaser" else add(role)
            if rng.random() < 0.9:
                n = rng.randint(1, 4)
                add("para", ("" if lang == "zh" else " ").join(pick("para") for _ in range(n)))
        for role, chance in (("share", 0.5), ("tags", 0.35), ("teasers", 0.55), ("letter", 0.35), ("comment", 0.5), ("legal", 0.6), ("legal", 0.3), ("footer", 0.6)):
            if rng.random() > chance:
                continue
            if role == "teasers":
                add("teaserhead")
                for _ in range(rng.randint(1, 5)):
                    teaser()
            elif role == "footer":
                bar("footer")
            else:
                add(role)
        style = rng.choice(["plain"] * 5 + ["flat", "semantic", "nested"])
        lines: list[str] = []
        labels: list[bool | None] = []
        now = None
        for role, text, keep in made:
            if not keep and rng.random() < 0.04:
                text = text.upper()
            if style == "flat":
                tag = _SEMANTIC[role] if keep else "div"
                text = f"<{tag}>{text}</{tag}>"
            elif style in ("semantic", "nested"):
                tag = _SEMANTIC[role]
                text = f'<li><a href="#">{text}</a></li>' if role in ("menu", "teaser") and rng.random() < 0.6 else f"<{tag}>{text}</{tag}>"
            if style == "nested":
                area = "article" if keep else {"menu": "header", "footer": "footer", "legal": "footer"}.get(role, "div")
                if area != now:
                    if now:
                        lines.append(f"</{now}>")
                        labels.append(None)
                    lines.append(f"<{area}>")
                    labels.append(None)
                    now = area
            if rng.random() < 0.15:
                lines.append("")
                labels.append(None)
            lines.append(text)
            labels.append(keep)
        if now:
            lines.append(f"</{now}>")
            labels.append(None)
        out.append({"title": title if rng.random() < 0.93 else None, "source_name": s if rng.random() < 0.95 else None, "lines": lines, "labels": labels})
    return out
