"""Natural paragraphs of many languages and styles, and some junk, written by hand for the fitting of the rule list.

The labelled documents of one corpus know few languages; these keep thresholds off ordinary texts of others.
"""

PROSE = (
    "The lengths of these streets were measured twice, and the strength of the thread surprised everyone who had thought about it for months.",
    "I think this breaks the build: `parseArgs` returns null when argv is empty, and src/cli/main.ts dereferences it. Could you add a guard and a test before we merge?",
    "Rhythm sections of two French horns, a harp and strings played throughout the night. Nobody slept; the lynx in the crypt slept least of all.",
    "LGTM, but two nits: (1) the ctx param shadows the outer ctx, and (2) rename tmp2 to something readable. Ship it after CI is green.",
    "At 09:15 on 3 March 2024 the job had read 1,284 of 2,000 files (64.2 %), so we expect it to end at about 10:40, twelve minutes later than on Monday.",
    "Die Geschwindigkeitsbegrenzung gilt auch nachts. Wer sie überschreitet, zahlt eine Strafe, denn der Rechtsstreit mit der Stadt ist längst entschieden.",
    "Im Herbst pflückt Großmutter Zwetschgen, schneidet sie klein und kocht daraus Mus. Deutschsprachige Kochbücher empfehlen, wenig Zucker zu nehmen.",
    "Le matin, les pêcheurs rentrent au port avec leurs filets pleins. On entend déjà les marchands qui crient leurs prix, tandis que l'âme de la ville s'éveille.",
    "Cuando llegó la primavera, los niños salieron a jugar al parque. Nadie recordaba ya el invierno, aunque todavía quedaba nieve en las montañas.",
    "Вчера вечером мы долго говорили о взгляде на всю эту историю. Здравствуй, сказал он, и все замолчали; после этого никто не хотел начинать первым.",
    "Взрослые обычно думают, что дети ничего не понимают. Но ребёнок чувствует всё: и радость, и усталость, и даже то, о чём взрослые молчат.",
    "Wczoraj wieczorem przyszedł do mnie sąsiad i opowiedział o swoich pszczołach. Chrząszcz brzmi w trzcinie, powtarzał, śmiejąc się z cudzoziemców.",
    "Včera večer přišel strýc a čtvrt hodiny mlčel. Pak řekl, že zmrzl cestou přes vrch a že by rád něco teplého k pití, než zase vyrazí domů.",
    "De herfststorm blies de bladeren van de bomen. In de verte hoorde men de klokken van de kerk, terwijl de slechtstziende buurman zijn hond uitliet.",
    "Igår kväll gick vi längs stranden och pratade om framtiden. Skymningen kom långsamt, och till slut var det bara vågorna som hördes.",
    "Tegnap este sokáig beszélgettünk a kertben. A gyerekek már aludtak, csak a tücskök ciripeltek, és néha elhúzott felettünk egy denevér.",
    "Eilen illalla kävelimme järven rannalla ja puhuimme tulevaisuudesta. Aurinko laski hitaasti, eikä kukaan halunnut lähteä kotiin.",
    "Dün akşam sahilde uzun uzun yürüdük ve gelecekten konuştuk. Güneş yavaş yavaş batarken kimse eve dönmek istemiyordu.",
    "Ontem à noite caminhámos pela praia e falámos do futuro. As crianças não queriam voltar para casa, porque a água ainda estava quente.",
    "Ieri sera abbiamo passeggiato lungo la spiaggia parlando del futuro. Il sole tramontava piano e nessuno aveva voglia di tornare a casa.",
    "Aseară ne-am plimbat îndelung pe plajă și am vorbit despre viitor. Când s-a întunecat, nimeni nu mai voia să plece acasă, în ciuda vântului.",
    "Tối qua chúng tôi đi dạo dọc bờ biển và nói chuyện về tương lai. Mặt trời lặn rất chậm, và không ai muốn về nhà.",
    "Χθες το βράδυ περπατήσαμε στην παραλία και μιλήσαμε για το μέλλον. Κανείς δεν ήθελε να γυρίσει στο σπίτι πριν δύσει ο ήλιος.",
    "مشينا مساء أمس على الشاطئ وتحدثنا طويلا عن المستقبل. كانت الشمس تغرب ببطء ولم يرغب أحد في العودة إلى البيت.",
    "אתמול בערב הלכנו לאורך החוף ודיברנו על העתיד. השמש שקעה לאט ואף אחד לא רצה לחזור הביתה.",
    "कल शाम हम समुद्र के किनारे टहले और भविष्य के बारे में बात करते रहे। सूरज धीरे-धीरे डूब रहा था और कोई घर लौटना नहीं चाहता था।",
    "เมื่อวานตอนเย็นเราเดินเล่นริมทะเลและคุยกันเรื่องอนาคต พระอาทิตย์ตกช้า ๆ และไม่มีใครอยากกลับบ้าน",
    "昨日の夕方、私たちは海辺を歩きながら将来について話した。日はゆっくりと沈み、誰も家に帰りたがらなかった。",
    "昨天傍晚我们沿着海边散步,聊了很久关于未来的事。太阳慢慢落下,没有人想回家。",
    "어제 저녁 우리는 바닷가를 걸으며 미래에 대해 이야기했다. 해가 천천히 졌고 아무도 집에 돌아가고 싶어 하지 않았다.",
    "Jana jioni tulitembea kando ya bahari na kuzungumza kuhusu siku zijazo. Jua lilizama polepole, na hakuna aliyetaka kurudi nyumbani.",
    "Kemarin sore kami berjalan di tepi pantai dan berbicara tentang masa depan. Anak-anak berlari-lari, dan tak seorang pun ingin pulang.",
    "Dnia 14.03.2021 r. o godz. 17:45 zmierzono 38,6°C i 12 mm deszczu; w nocy z 15. na 16. było już tylko -2,5°C (czyli o 41,1° mniej).",
    "2019-cu ildə 1 250 ədəd, 2020-ci ildə 1 480 (18,4 % çox), 2021-ci ildə isə cəmi 960 ədəd satıldı; qiymət 3,20-dən 4,75-ə qalxdı.",
    "Mnamo 12/4/2018 (saa 9:30) watu 1,204 walipiga kura; 2022 walikuwa 1,877, yaani +55.9 %, na 64 kati yao walikuwa na umri wa miaka 80+.",
    "v2.3.1: bump `lru-cache` 6.0.0 -> 7.14.1, drop node 12, fix #482 (EPERM on win32), x64/arm64 builds now ~14 % smaller; thx @k8smith!",
    "Prst strčil skrz krk a vlk zmrkl. Škrt plch z mlh Brd pln skvrn z mrv prv hrd scvrnkl z brzd skrz trs chrp v krs vrb mls mrch srn čtvrthrst zrn.",
    "Smrt u tvrđavi: prst, krv i crn trn. Vrh brda bio je strm, grm trnja tvrd, a hrt je stražario kraj vrta dok je grmljavina trajala.",
    "Gvprtskvni da gvbrdghvnis, amboben kartvelebi. Mtsvrtneli mtshraliad ikitkhavs: ras gviqvebit, rodesac ghame dgeba da mtvare ar chans?",
    "Nachts schlich der Schlachtschiffskapitän durchs Borschtschgeschäft. Herbstschmuck, Strumpfschrank, Kirschkernschnaps: selbst Angstschweiß half nichts.",
)

JUNK = (
    "VGhlIHF1aWNrIGJyb3duIGZveCBqdW1wcyBvdmVyIHRoZSBsYXp5IGRvZyBhbmQgcnVucyBhd2F5IGZyb21IZXJl",
    "iVBORwKGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVRkYPhfDwAChwGAkwqGAAAAAElFTkSuQmCCxZ",
    "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQgY29uc2VjdGV0dXIgYWRpcGlzY2luZyBlbGl0IHNlZA", "aGVsbG93b3JsZHRoaXNpc25vdGhpbmdidXRhYmxvYm9mbGV0dGVycw==QkxPQkJMT0JCTE9CQkxPQg",
    "4d 5a 90 00 03 00 00 00 04 00 00 00 ff ff 00 00 b8 00 00 00 00 00 00 00 40 00 00 00", "DE AD BE EF CA FE BA BE 00 01 02 03 0A 0B 0C 0D",
    "sdkfj hsdkfjh wkjrh qpwk zmxnc bvqpl wrtsk djfhg mznxb qwlkr pxcvn hjkls tyrwq", "xkcdq brzlp vntrw ghjqk mplsd wqrtz cvbnx fgthj klmpw sdrtq zxwvb nhgfd prtqs",
    "la la la la la la la la la la la la la la la la la la", "foo bar foo bar foo bar foo bar foo bar foo bar foo bar foo bar",
    "#$%& *()_ +|~= {}[] <>?/ ;:'\" !@#$ %^&* ()_+ |{}: <>?~", ".....:::::.....-----.....:::::-----=====-----",
    "nwo si teh r  eimt ofr lla dgo o emn ot  e cmo t  aid  fo ehtri p a rty ,dna t he", "h  te q ciuk bn rwo f x o mj up ed v o re th el a zy d go an d ra n aw y  ag nai",
    "l?s d?n?es s?nt ill?sibl?s d?p?is l? d?rni?re s?uv?g?rd? d? s?r?eu?", "w\ufffdrds w\ufffdth\ufffdut v\ufffdw\ufffdls \ufffdre h\ufffdrd t\ufffd r\ufffd\ufffdd",
)
