"""Word lists for abusive, hateful and sexual content, and the folding under which they are matched.

The lists are general vocabulary of several languages, written from common knowledge of the languages and not from the
documents that are scored: what is particular to a corpus is learnt from its labels (see abuse.fit). Entries are
written as folded: lower case, without accents. Plurals in s and es are matched by rule.
"""

from __future__ import annotations

import re
import unicodedata

#: Words that insult wherever they stand.
INSULT = """
moron imbecile cretin dumbass jackass dickhead shithead asshole arsehole bastard scumbag halfwit wanker tosser bitch
dipshit retard twat cunt whore slut motherfucker nitwit dimwit numbskull knucklehead dunce scum lowlife douchebag
douche asswipe asshat cocksucker fuckwit fuckface bellend knobhead tool pillock plonker prick schmuck simpleton
arschloch wichser missgeburt vollidiot hurensohn schlampe fotze drecksau trottel spast miststuck dummkopf
imbecil pendejo cabron gilipollas hijoputa zorra maricon capullo mamon baboso tarado
enfoire connard connasse salope encule batard abruti cretin bouffon ordure
babaca retardado otario cuzao arrombado corno vagabunda desgracado
stronzo coglione puttana bastardo cretino deficiente klootzak hoer sukkel debiel kurwa debil suka dupek
сука блядь дебил мудак тварь урод мразь ублюдок придурок
傻逼 白痴 混蛋 贱人 王八蛋 クズ 馬鹿 バカ アホ 畜生
""".split()
#: Words that insult somebody but also occur in plain speech.
MILD_INSULT = """
idiot idiota idiotic stupid pathetic worthless miserable spineless useless ugly brainless braindead braindamaged
disgusting liar pig dumb fool foolish clown trash garbage loser creep coward parasite maggot cockroach rat snake
ignorant incompetent hopeless lazy filthy rotten vile repulsive fat freak weirdo joke waste disgrace failure
blod blode dumm dumme dummer idioten sau faul hasslich widerlich wertlos tonto inutil estupido feo asqueroso basura
nul nulle debile conne con bete moche lache inutile burro lixo idiotas nojento porco feio scemo stupido schifoso dom
глупый тупой идиот 笨 蠢 废物 垃圾
""".split()
PROFANE = """
fuck fucking fucked fucker fuckin shit shitty bullshit ass arse piss pissed crap goddamn damn damned bloody bugger
bollocks hell wtf stfu gtfo screw suck sucks scheiss scheisse verpiss verdammt mist fick mierda joder cono carajo puta
hostia merde putain foutre gueule chier bordel niquer nique merda caralho porra foder cazzo merda vaffanculo kut
godverdomme cholera pierdol хуй пизда блять нахуй 操 他妈的 くそ
""".split()
THREAT = """
kill murder die death dead choke drown smash knife stab shoot gun bullet strangle burn hang beat punch hurt rape
destroy bleed blood grave corpse suicide hunt slit throat bomb execute slaughter exterminate regret revenge
umbringen toten sterben stirb tot erschiessen aufhangen abstechen verrecke prugeln matar muere muerte morir ahorcar
tuer crever creve mourir mort pendre egorger morra morre matarei enforcar morire ammazzare uccidere crepa sterf dood
убью сдохни умри 死ね 殺す 去死 杀
""".split()
HATE = """
vermin subhuman filth filthy infest infestation disease plague lice rats cockroaches parasites savages breed breeding
inferior deport deported exterminate exterminated eradicate cleanse cleansed purge gas gassed lynch expel expelled
invaders degenerate degenerates scum thieves criminals animals apes monkeys untermenschen ungeziefer vertreiben raus
abschieben vergasen pack gesindel alimanas escoria plaga fuera expulsar racaille vermine dehors parasites expulser
pragas escoria expulsar sumam faggot fag dyke tranny nigger negro kike spic chink gook wetback paki raghead towelhead
gypsies kanake schwuchtel neger zigeuner maricones negrata sudaca bougnoule youpin bicha viado нацмен хач
""".split()
SEXUAL = """
cock dick pussy porn porno pornographic tits titties boobs nipple panties horny nudes cum cumming dildo blowjob orgasm
handjob boner erection masturbate masturbating masturbation anal fellatio bukkake threesome milf hentai ejaculate
titten ficken fickt muschi schwanz geil wichsen follar follando coger polla chocho tetas corrida verga chupame
baiser bite chatte nichons branler sucer foutre piroca buceta pelada gozar transar punheta boquete scopare figa cazzo
tette neuken geile lul dupa cipka порно сиськи трахать ебать член 做爱 色情 エロ セックス
""".split()
MILD_SEXUAL = """
naked nude sex sexy sexual sexually thighs tongue lick licking skin wet hot hard bare begging legs aroused moan moaning
thrust underwear bra lingerie strip undress bed bedroom kiss kissing touch touching lust erotic intimate escort cam
webcam hookup nackt nackte brust bruste desnudo desnuda desnudos caliente pechos nu nue seins nues chaude nua pelado
seios nuda seno naakt borsten голая секс 裸 裸体
""".split()
SECOND_PERSON = """
you your yours yourself youre youve youll u ya ur du dich dir dein deine deinen deiner ihr euch euer tu te ti tus eres
usted ustedes vosotros toi ton ta tes vous votre vos voce voces seu sua seus suas teu tua tuo tuoi sei voi vostro jij
jou jouw jullie ty twoj ты тебя твой вы ваш 你 你们 お前 あなた
""".split()
FIRST_PERSON = """
i im ive ill my me mine myself we our us ich mich mir mein meine wir je moi ma mon mes nous yo mi mis nosotros eu meu
minha io mio mia ik mijn ja moj я мой 我 私 俺
""".split()
PEOPLE = """
people women woman men man girl girls boy boys children kids child guys they them their those these everyone anybody
somebody he him his she her leute menschen frauen manner kinder sie gente mujeres hombres ellos gens femmes hommes ils
elles enfants pessoas mulheres homens eles persone donne uomini mensen vrouwen mannen люди женщины
""".split()
#: Groups of people by origin, faith, sex or the like.
GROUPS = """
jews jewish muslims muslim islam christians christian catholics hindus sikhs arabs arab blacks whites asians asian
africans african mexicans latinos hispanics chinese indians turks poles russians americans europeans immigrants
migrants foreigners refugees gays gay lesbians lesbian homosexuals trans transgender queers feminists liberals
conservatives gypsy roma natives tribe race races ethnic minorities nation juden muslime auslander fluchtlinge turken
judios musulmanes negros inmigrantes extranjeros juifs musulmans arabes noirs immigres etrangers judeus muculmanos
imigrantes estrangeiros ebrei stranieri joden buitenlanders евреи мигранты 外国人
""".split()
#: Technical, medical and everyday surroundings in which such words mean no harm.
PLAIN = """
process processes thread threads daemon job jobs signal child parent orphan zombie fork branch master slave node
server client socket connection query table row column index cache buffer pointer memory garbage collector compile
runtime kernel script command shell terminal flag exception error errors test tests assert dataset feature features
sample samples model training variable array matrix function method object class string value values parameter plot
patient patients clinical medical cancer tumor tumour screening therapy treatment diagnosis hospital surgery symptoms
disease infection health anatomy tissue cell cells gene genes protein species bird birds animal animals breeding farm
crop soil water temperature pressure sensor analysis experiment measurement percent rate rates study survey education
moderation moderator policy filter comment comments reported report removed spam flagged label labels annotation
dictionary word words term term quote quoted novel chapter history historical century painting museum
prozess datei fehler tabelle patienten behandlung tier tiere proceso archivo fila pacientes tratamiento animales
processus fichier ligne patients traitement animaux processo arquivo linha pacientes tratamento animais
""".split()

CATEGORIES = ("insult", "mild_insult", "profane", "threat", "hate", "sexual", "mild_sexual", "second", "first", "people", "group", "plain")
_LISTS = (INSULT, MILD_INSULT, PROFANE, THREAT, HATE, SEXUAL, MILD_SEXUAL, SECOND_PERSON, FIRST_PERSON, PEOPLE, GROUPS, PLAIN)
#: The first so many categories are what is looked for; the others are surroundings.
N_HOT = 7
HOT = (1 << N_HOT) - 1

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авеиклмнорстухѕіјԁӏѵαεικνορτυχ", "abeuklmhopctyxsijdlvaeiknoptux")
#: Digits and signs written for letters.
LEET = str.maketrans("0134578@$!", "oieastbasi")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u3164\ufe00-\ufe0f\ufeff]")
_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][\u0370-\u052f]|[\u0370-\u052f][A-Za-z])[^\W\d_]*")
_GREEK_CYRILLIC = re.compile("[\u0370-\u052f]")
_MARKS = re.compile("[\u0300-\u036f\u3099\u309a]+")


def fold(text: str) -> str:
    """Compatibility forms resolved, accents dropped, look-alikes in mixed words made Latin; case is kept, but in those."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text)).replace("ß", "ss").replace("ı", "i")
    text = _MARKS.sub("", text)
    return _MIXED.sub(lambda m: m[0].lower().translate(LOOKALIKES), text) if _GREEK_CYRILLIC.search(text) else text


EAST = "\u3040-\u30ff\u3400-\u9fff"
_EAST = re.compile(f"[{EAST}\uff66-\uff9f]")
_KATAKANA = "[\u30a1-\u30fa\u30fc]"
#: Listed words of scripts without blanks. Those in katakana are not looked for inside of longer loan words.
_UNSPACED = re.compile(
    "|".join(
        f"(?<!{_KATAKANA}){w}(?!{_KATAKANA})" if re.fullmatch(f"{_KATAKANA}+", w) else w
        for w in sorted({w for words in _LISTS for w in words if _EAST.search(w)}, key=lambda w: (-len(w), w))
    )
)


def part(text: str) -> str:
    """The text with blanks around listed words of scripts that have none."""
    if text.isascii() or not _EAST.search(text):
        return text
    return _UNSPACED.sub(r" \g<0> ", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)))


_REPEATED = re.compile(r"(.)\1+")


def skeleton(word: str) -> str:
    """One spelling for drawn-out letters and for l written as i."""
    return _REPEATED.sub(r"\1", word).replace("l", "i")


def _members() -> dict[str, int]:
    """word -> bits of its categories."""
    out: dict[str, int] = {}
    for bit, words in enumerate(_LISTS):
        for w in words:
            w = fold(w)
            forms = (w, w + "s", w + "es") if bit in (0, 1, 5) and len(w) > 2 and w.isascii() else (w,)
            for form in forms:
                out[form] = out.get(form, 0) | 1 << bit
    return out


WORDS = _members()
#: Words worth recovering from a disguise.
DISGUISED = frozenset(w for w, bits in WORDS.items() if bits & HOT and len(w) > 2)
#: Long ones by their skeleton.
SKELETONS = {skeleton(w): w for w in sorted(DISGUISED) if len(w) > 4 and len(skeleton(w)) > 3}
