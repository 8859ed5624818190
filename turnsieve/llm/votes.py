"""Votes on a text: its language by scripts and function words, and whether it declines.

Languages written in Latin letters are told apart by closed-class words only (articles, pronouns,
prepositions, conjunctions, auxiliaries), other languages by script together with particles. Refusals
are accepted by a finite automaton over classes of atoms: an Aho-Corasick automaton finds the atoms
of all languages in one pass, and the state is the set of classes seen since the sentence began.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

# Closed-class words by language, with words of fixed adverbials such as "am Ende".
FUNCTION_WORDS = {
    "en": "the a an is are was were be been being as in on at of to and or but by for with from that this these those it its they them their he she him his her hers i me you we us my your our not no do does did done has have had will would shall should can could may might must so if when while then than there here what which who whom whose how where why about into onto over under after before between through during near until because although though since both each every some any most more such only very just also too again now",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird wurde werden sein am im ins zum zur vom beim in mit für von zu auf aus an bei nach über unter vor nicht kein keine sich er sie es wir ihr ihm ihn man hat haben hatte kann können soll sollte möchte muss dass weil wenn wie was wer wo so auch nur noch schon als bis um durch gegen ohne laut nahe dann hier dort schluss ende zuletzt mehrere ihre ihren seine seinen dieser diese dieses",
    "es": "el la los las lo un una unos unas y e o u pero es son era fue ser está están en de del al con sin para por que se su sus según como cuando donde qué quién cómo no ni sí ya muy más también le les me te nos mi tu yo él ella ellos ha han hay había sobre entre hasta desde este esta estos estas ese esa cerca varias varios uno final",
    "fr": "le la les l un une des du de d qu c n s j à fin et ou mais est sont était été être ont au aux en dans sur sous avec sans pour par que qui se s sa son ses ce cette ces il elle ils elles on nous vous je tu ne pas plus ni si y où comme quand dont leur leurs mon ma mes ton ta tes près chez vers entre après avant depuis selon après plusieurs",
    "it": "il lo la l d gli le un uno una e ed o ma è sono era essere stato in di del della dei degli delle dello al alla ai alle dal dalla nel nella nei nelle sul sulla con senza per che chi si suo sua suoi sue non né più come quando dove anche ha hanno ho questo questa questi queste tra fra su da secondo lui lei loro noi voi io perché",
    "pt": "o os as um uma uns umas e ou mas é são era foi ser está em no na nos nas de do da dos das ao aos à às com sem para por pelo pela que quem se seu sua seus suas não nem mais como quando onde também tem têm há sobre entre até desde este esta esse essa isso ele ela eles elas nós você eu segundo",
    "nl": "de het een en of maar is zijn was waren wordt werd in op aan van voor met zonder naar bij uit over onder tot om te dat die dit deze er hij zij ze wij we jullie ik mijn uw haar hun niet geen ook nog al als dan wat wie waar hoe wil heeft hebben had kan kunnen moet zal zou volgens",
    "sv": "en ett den det de och eller men är var vara blir blev i på av för med utan till från om under över vid hos att som han hon vi ni jag min din sin inte ingen också så när där här vad vem hur har hade kan ska skulle vill enligt",
    "pl": "w we na z ze do od po za dla przez przy o u nad pod że się nie jest są był była było być to ten ta te tego tej tym jak co kto gdzie czy ale lub oraz już tylko też jego jej ich ma mają może chce według",
    "tr": "bir ve veya ama ile için bu şu o da de ki mi mı ne kim nasıl nerede çok daha en gibi kadar sonra önce değil var yok olan olarak ise onun ben sen biz siz onlar göre",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Words after which no sentence ends, and finite auxiliaries, which only sentences have.
DANGLING = frozenset("the a an of and or but because with from as if than that which whose is was were are has had into your my our their der die das dem den des ein eine einen und oder weil mit für von zum zur el la los las un una y o porque con para de del que le les des du et ou avec pour il gli ed perché per della nel na no dos das e com het een met voor".split())
FINITE = frozenset("is are was were has have had will would should can could ist war hat hatte wird möchte soll kann es fue está ha había quiere est était ont été sont è era hanno vuole é foi está quer był jest wil heeft".split())
# Scripts by code points, and closed-class words or particles that show a sentence in them.
SCRIPTS = {
    "zh": (r"[㐀-鿿豈-﫿]", r"[的了在是为和与或及把被要想就都也很]|根据|最后|最终|应该|一[间张个家份]|几[个人]"),
    "ko": (r"[ᄀ-ᇿ가-힣]", r"(?:[은는이가을를의]|에서|으로|에게|입니다|합니다|습니다|따르면|위해)(?=[\s.,]|$)"),
    "ja": (r"[぀-ヿ]", r"[はがをにのでとも]|です|ます"),
    "ru": (r"[Ѐ-ԯ]", r"\b(?:и|в|во|не|на|что|с|со|по|для|как|это|он|она|они|его|её|их|из|у|к|за|от|до|но|или|же|бы|был|была|было|были|есть|так|при|о|об|та|і|й|що|від|до|е|са|се|със|който)\b"),
    "el": (r"[Ͱ-Ͽἀ-῿]", r"\b(?:ο|η|το|οι|τα|του|της|των|τον|την|και|να|με|σε|στο|στη|στην|για|από|που|είναι|θα|δεν|ένα|μια|ως|κατά)\b"),
    "ar": (r"[؀-ۿݐ-ݿ]", r"\b(?:في|من|على|إلى|عن|أن|هذا|هذه|هو|هي|كان|لا|ما|مع|التي|الذي)\b|ال\w{3,}"),
    "he": (r"[֐-׿]", r"\b(?:של|על|את|זה|לא|הוא|היא|עם|אל|או|כי)\b|ה\w{3,}"),
    "hi": (r"[ऀ-ॿ]", r"(?:है|हैं|का|की|के|में|को|से|और|पर|था|थी)(?=[\s।,.]|$)"),
    "th": (r"[฀-๿]", r"ที่|และ|ใน|ของ|เป็น|ไม่|ได้|ให้|จะ|มี"),
}
_SCRIPTS = {k: (re.compile(a), re.compile(f"{a}+(?: {a}+)*"), re.compile(b)) for k, (a, b) in SCRIPTS.items()}
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"(?:qu|[ldcnsjmt])(?=['’])|[^\W\d_]+(?:['’][^\W\d_]+)*", re.I)
#: Small words inside a name in the Romance manner say nothing about the language around it.
_PARTICLES = re.compile(r"(?<=[^\W\d_] )(?:(?:de|la|las|los|el|del|du|des|le|les|di|da|do|dos|das|della|van|von|y|e|et) )+(?=[A-ZÀ-Þ])")
_PARTS = re.compile(r"[.,;:!?。，；：！？、\"“”()\[\]{}\n]+")
#: Letters of a foreign script that make a sentence only together with a particle of it.
LEAST_LETTERS = 4


def letters(lang: str, text: str) -> int:
    return len(_SCRIPTS[lang][0].findall(text))


def function_votes(text: str) -> dict[str, int]:
    """How many words of the text are closed-class words of each language in Latin letters."""
    words = [w.replace("’", "'") for w in _WORD.findall(_PARTICLES.sub("", text).lower())]
    return {k: sum(w in v for w in words) for k, v in WORDS.items()}


def language(text: str) -> str:
    """Language of a prompt by its most frequent script, Latin by votes of function words."""
    n = {k: letters(k, text) for k in _SCRIPTS}
    latin = len(_LATIN.findall(text))
    if n["ko"] and n["ko"] >= max(n["zh"], 1) and n["ko"] * 3 > latin:
        return "ko"
    if n["ja"] and n["ja"] * 5 > n["zh"]:
        return "ja"
    best = max((k for k in n if k not in ("ko", "ja")), key=n.get)
    if n[best] * 4 > latin:
        return best
    votes = function_votes(text)
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    return best if votes[best] else "en"


def other_language(text: str, context: str, own: str) -> bool:
    """Whether the text is a sentence or phrase of another language than `own`. Runs of a foreign
    script that stand in the context are names and values of the prompt and do not count."""
    free = {}
    for lang, (one, run, particle) in _SCRIPTS.items():
        if not one.search(text):
            free[lang] = 0
            continue
        left = [r for r in run.findall(text) if r not in context]
        free[lang] = sum(letters(lang, r) for r in left)
        same = lang == own or lang == "zh" and own == "ja"
        if not same and free[lang] >= LEAST_LETTERS and any(particle.search(text, m.start(), m.end()) for m in run.finditer(text) if m[0] in left or lang in ("zh", "ko")):
            return True
    votes = function_votes(text)
    best = max(votes, key=votes.get)
    if own in _SCRIPTS:
        return votes[best] >= 2 and (len(_LATIN.findall(text)) > 2 * free[own] or not _SCRIPTS[own][2].search(text))
    if best != own and votes[best] >= 2 and votes[best] > votes.get(own, 0):
        votes = function_votes(" . ".join(p for p in _PARTS.split(text) if p.strip() and p.strip() not in context))
        best = max(votes, key=votes.get)
        return best != own and votes[best] >= 2 and votes[best] > votes.get(own, 0)
    return False


# --- refusals ----------------------------------------------------------------------------------

SELF, NEGATED, ACT, SORRY, POLICY, DEFLECT, DECLINE = (1 << i for i in range(7))
# Atoms of refusals by class, in lower case, all languages together.
ATOMS = {
    SELF: ("i ", "i'm ", "i’m ", "i'd ", "i'll ", "we ", "me to", "for me", "my ", "as an ai", "language model", "language assistant", "this assistant", "我", "本助手", "语言助手", "저는", "제가", "저희", "ich ", "wir ", "mir ", "je ", "nous ", "me ", "yo ", "io ", "eu ", "я ", "мне ", "мы ", "私", "当方"),
    NEGATED: (
        "can't", "can’t", "cannot", "can not", "unable", "not able", "won't", "won’t", "will not", "not allowed", "not permitted", "not have the ability", "not capable", "not in a position", "not something", "irresponsible", "inappropriate", "not appropriate", "not be appropriate", "wouldn't be appropriate", "couldn't", "could not", "shouldn't", "don't feel comfortable", "not comfortable",
        "无法", "不能", "没有办法", "没办法", "不便", "不可以", "不方便", "수 없", "어렵습니다", "어려워요", "곤란", "못합니다", "않습니다", "안 됩니다", "벗어납니다",
        "kann nicht", "kann ich nicht", "kann ihnen nicht", "kann dazu nicht", "kann dir nicht", "kann leider nicht", "kann ich ihnen nicht", "kann ich leider nicht", "nicht beantworten", "nicht in der lage", "darf nicht", "darf ich nicht", "darf keine", "kann keine", "no puedo", "no podemos", "no me es posible", "no estoy autorizad", "no tengo permitido", "ne peux pas", "ne peux malheureusement pas", "ne pouvons pas", "ne suis pas en mesure", "ne suis pas autoris", "m'est impossible", "non posso", "non possiamo", "non sono in grado", "não posso", "não podemos", "não consigo", "не могу", "не можем", "не в состоянии", "できません", "できかねます", "致しかねます", "いたしかねます",
    ),
    ACT: (
        "help", "assist", "answer", "respond", "provid", "discuss", "comply", "share", "do that", "can do", "fulfil", "going into", "go into", "engage", "do so", "give you", "talk about", "continue", "proceed", "support", "complete", "offer", "to say",
        "回答", "提供", "协助", "帮助", "讨论", "满足", "处理", "回应", "完成", "服务", "透露", "제공", "답변", "대답", "도와", "도움", "다룰", "말씀", "논의", "응답", "설명", "따를",
        "helfen", "weiterhelfen", "beantworten", "unterstützen", "bereitstellen", "auskunft", "dienen", "ayudar", "responder", "proporcionar", "facilitar", "contestar", "aider", "répondre", "fournir", "assister", "discuter", "donner", "aiutar", "risponder", "fornir", "ajudar", "fornecer", "помочь", "ответить", "предоставить", "обсуждать", "お答え", "お手伝い", "ご案内", "回答", "対応",
    ),
    SORRY: ("sorry", "apolog", "i'm afraid", "i am afraid", "regret", "unfortunately", "thanks for asking", "抱歉", "对不起", "遗憾", "죄송", "안타깝", "유감", "leider", "tut mir leid", "entschuldig", "lo siento", "lamento", "lamentablemente", "disculp", "désolé", "regrette", "malheureusement", "navré", "mi dispiace", "purtroppo", "desculpe", "infelizmente", "извините", "к сожалению", "простите", "申し訳", "すみません", "残念"),
    POLICY: ("guidelines", "policy", "policies", "goes against", "go against", "not allowed to", "outside of what", "outside the scope", "beyond what", "beyond the scope", "what i am allowed", "what i'm allowed", "keep me from", "prevent me from", "超出", "规定", "准则", "范围", "지침", "허용", "범위", "richtlinien", "directrices", "política", "directives", "politique", "linee guida", "diretrizes", "правила"),
    DEFLECT: ("different topic", "another topic", "change the topic", "change the subject", "something else instead", "to a human", "human agent", "换个话题", "换一个话题", "人工客服", "상담원", "다른 주제", "다른 이야기", "thema wechseln", "cambiar de tema", "changer de sujet", "parler d'autre chose", "cambiare argomento", "mudar de assunto", "сменим тему", "別の話題"),
    DECLINE: ("must decline", "have to decline", "i decline", "i refuse", "must refuse", "have to refuse", "have to skip", "i'd rather not", "i would rather not", "i will have to pass", "只能拒绝", "拒绝这", "必须拒绝", "거절할 수밖에", "거절합니다", "건너뛰", "muss ich ablehnen", "muss ablehnen", "lehne ich ab", "debo declinar", "debo rechazar", "me niego", "je dois refuser", "je dois décliner", "devo rifiutare", "devo recusar", "вынужден отказать", "お断り"),
}
#: Accepting states: classes that together make a refusal within one sentence.
ACCEPT = (DECLINE, NEGATED | ACT | SELF, NEGATED | ACT | SORRY, NEGATED | SORRY | POLICY, POLICY | SELF | SORRY, POLICY | SELF | ACT, DEFLECT | SORRY, DEFLECT | ACT)
#: Classes that refuse without a subject or an apology where a language leaves the subject out or a text has nothing else.
_ALONE = re.compile(r"\blet(?:'s| us) (?:talk about|discuss|change|move)|换(?:个|一个)话题|다른 (?:주제|이야기)|수 없습니다|어렵습니다|できません|かねます")
_BREAK = re.compile(r"(?<=[.!?])\s+|[。！？\n]+")


@lru_cache(1)
def _atoms() -> ahocorasick.Automaton:
    classes: dict[str, int] = {}
    for kind, atoms in ATOMS.items():
        for atom in atoms:
            classes[atom] = classes.get(atom, 0) | kind
    made = ahocorasick.Automaton()
    for atom, kinds in classes.items():
        made.add_word(atom, (len(atom), kinds, atom[0].isascii() and atom[0].isalpha()))
    made.make_automaton()
    return made


def declines(text: str) -> str | None:
    """The sentence by which a text declines, or None."""
    automaton = _atoms()
    for sentence in _BREAK.split(text):
        low = f" {sentence.lower()} "
        state = 0
        for end, (size, kinds, at_word) in automaton.iter(low):
            if not at_word or not low[end - size].isalnum():
                state |= kinds
        if any(state & mask == mask for mask in ACCEPT) or state & (NEGATED | DEFLECT) and state & (ACT | DEFLECT) and _ALONE.search(low):
            return sentence
    return None
