"""Word lists and the generated dimension of Vietnamese syllables."""

from __future__ import annotations

import unicodedata
from functools import cache

# Word lists of the language model, as they must be for equal scores.
VI_FUNCTION_WORDS = (
    "và của cho trong không được các một với người theo khi từ là có này những để đã sẽ bị lên trước sau đến "
    "như cũng hoặc nếu thì mà nên vì phải cần đang rất nhiều đó đây tại về ra vào bằng hơn chưa đều lại"
).split()
VI_PLAIN_FUNCTION_WORDS = (
    "khong duoc cua nguoi nhung voi cac mot theo truoc nhieu cung hoac neu phai dang trong thi vao bang chua khi"
).split()
EN_FUNCTION_WORDS = (
    "the of and to in is for on with this that be are must after before from by as at or it will should not was were "
    "has have can all if an a our we you they into than"
).split()
VI_SURNAMES = (
    "nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly dinh trinh mai cao lam truong ta ha "
    "luong thai quach tong chu kieu dao dam khuc lai tang doan"
).split()
VI_MIDDLE_NAMES = (
    "van thi duc minh huu quoc ngoc thanh xuan anh hoang kim cong dinh thu bao gia hong manh tuan quang phuong my tien"
).split()
VI_PLACE_WORDS = (
    "vietnam viet nam ha noi hai phong da nang ho chi minh sai gon bac ninh hung yen thai nguyen binh duong dong nai "
    "can tho hue vinh phuc quang long an giang thanh hoa"
).split()

# Onsets, rhymes without tones, and the characters that count as strong or weak evidence.
ONSETS = ["", *"b c ch d đ g gh gi h k kh l m n ng ngh nh p ph qu r s t th tr v x".split()]
RHYMES = (
    "a ai ao au ay am an ang anh ap at ac ach ă ăm ăn ăng ăp ăt ăc â âm ân âng âp ât âc âu ây "
    "e eo em en eng ep et ec ê êu êm ên ênh êp êt êch i ia iu im in inh ip it ich iêu iêm iên iêng iêp iêt iêc "
    "o oi om on ong op ot oc oa oai oao oay oam oan oang oanh oap oat oac oach oăm oăn oăng oăt oăc oe oeo oen oet ooc oong "
    "ô ôi ôm ôn ông ôp ôt ôc ơ ơi ơm ơn ơp ơt u ua ui um un ung up ut uc "
    "uân uâng uât uây uê uêch uênh uơ uy uya uych uyên uyêt uynh uyp uyt uyu uôi uôm uôn uông uôt uôc "
    "ư ưa ưi ưu ưm ưn ưng ưt ưc ươi ươu ươm ươn ương ươp ươt ươc y yêm yên yêng yêt yêu"
).split()
STRONG = "ăđơưĩũĂĐƠƯĨŨẠ-ỹ"
WEAK = "àáâãèéêìíòóôõùúýÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝ"
GRAVE, ACUTE, TILDE, HOOK, DOT = "̣̀́̃̉"

# Which rhymes may not follow which onsets, by the rhyme's first letter.
ONLY_BEFORE = {"k": "eêiy", "gh": "eêiy", "ngh": "eêiy"}
NEVER_BEFORE = {"c": "eêi", "g": "eêi", "ng": "eêi", "qu": "uo", "gi": "i"}
EXTRA_SYLLABLE = "gi"


def strip_marks(s: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")
    return bare.replace("đ", "d").replace("Đ", "D")


@cache
def marked_syllables() -> tuple[str, ...]:
    """Syllables without tones: every onset with every rhyme that the spelling allows after it."""

    def allowed(onset: str, rhyme: str) -> bool:
        return rhyme[0] in ONLY_BEFORE.get(onset, rhyme[0]) and rhyme[0] not in NEVER_BEFORE.get(onset, "")

    made = {onset + rhyme for onset in ONSETS for rhyme in RHYMES if allowed(onset, rhyme)}
    return tuple(sorted(made | {EXTRA_SYLLABLE}))


@cache
def plain_syllables() -> tuple[str, ...]:
    return tuple(sorted({strip_marks(s) for s in marked_syllables()}))


@cache
def letters() -> tuple[str, ...]:
    """Letters with marks that normalise to one character: Latin supplements and extensions."""
    spans = ((0xC0, 0x250), (0x1E00, 0x1F00))
    return tuple(chr(i) for a, z in spans for i in range(a, z) if chr(i).isalpha() and len(unicodedata.normalize("NFC", chr(i))) == 1)


@cache
def bare_table() -> tuple[str, str]:
    """(from, to) for translate: letters and what is left of them without any mark."""
    pairs = [(c, strip_marks(c)) for c in letters() if strip_marks(c) != c and len(strip_marks(c)) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def tone_table() -> tuple[str, str]:
    """(from, to) for translate: letters with one tone mark, and the same without it."""
    tones, pairs = {GRAVE, ACUTE, TILDE, HOOK, DOT}, []
    for c in letters():
        apart = unicodedata.normalize("NFD", c)
        if sum(m in tones for m in apart) == 1:
            rest = unicodedata.normalize("NFC", "".join(m for m in apart if m not in tones))
            if len(rest) == 1:
                pairs.append((c, rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def not_before_stop() -> str:
    """Letters whose tone can't stand in a syllable that ends in a stop."""
    return "".join(c for c in tone_table()[0] if {GRAVE, TILDE, HOOK} & set(unicodedata.normalize("NFD", c)))
