"""Word lists of the cues, markers and labels that results depend on. All are defaults of parameters."""

# Beginnings of words that tell of a good, a bad or a decisive moment.
POSITIVE = ("love", "hope", "happy", "saved", "safe", "won", "victory", "trust", "sev", "umut", "mutlu", "kurtul", "kazan", "zafer", "güven")
NEGATIVE = ("hate", "fear", "afraid", "die", "dead", "lost", "betray", "hurt", "kill", "terrible", "nefret", "kork", "öl", "kaybet", "ihanet", "acı", "öldür")
DECISION = ("decide", "choose", "must", "promise", "confess", "truth", "sacrifice", "betray", "karar", "seç", "zorunda", "itiraf", "gerçek", "fedak", "ihanet")

# Last words that leave a sentence open, and first words that go on with one.
DANGLING = ("ama", "ancak", "fakat", "çünkü", "ve", "veya", "yahut", "ki", "yani", "oysa", "halbuki", "eğer", "şayet", "iken", "ile")
CONTINUATION = (*DANGLING, "de", "da", "ise", "sonra", "ardından", "böylece", "bu yüzden")

# Terms of the turning points.
EVENT_TERMS = {
    "inciting_incident": ("must", "need to", "have to", "attack", "threat", "mission", "disappear", "tehdit", "görev", "saldır", "zorunday"),
    "midpoint": ("decide", "truth", "reveal", "betray", "sacrifice", "choose", "karar", "gerçek", "ihanet", "fedak"),
    "climax": ("defeat", "victory", "win", "save", "die", "sacrifice", "final", "end", "kazan", "zafer", "kurtar", "öld", "fedak"),
    "resolution": ("saved", "survived", "peace", "won", "returned", "reunited", "safe", "kurtuldu", "kazandı", "barış", "geri dönd", "birleş"),
}

# Parts of texts that mark an event, action, music or credits, and phrases of captions that say nothing.
CHAIN_MARKERS = ("sacrifice", "death", "dies", "killed", "victory", "wins", "reveal", "hammer", "snaps", "final blow", "fedak", "öl", "oldur", "öldür", "kazan", "zafer", "çekic", "cekic", "şaşırt", "sasirt", "ortaya çık")
ACTION_WORDS = ("fight", "run", "chase", "gun", "shoot", "explosion", "attack", "punch", "kick", "crash", "dövş", "koş", "kovala", "silah", "ateş", "patlama", "saldır", "yumruk", "tekme", "çarpış")
MUSIC_WORDS = ("music", "müzik", "sing", "song", "şarkı")
CREDIT_WORDS = ("credit", "credits", "jenerik", "cast and crew", "directed by", "produced by", "executive producer", "yönetmen", "yapımcı", "oyuncular", "başroller", "title card", "film title")
GENERIC_CAPTIONS = ("movie trailer", "coming to theaters", "coming to cinemas", "the avengers movie", "transformers transformers")

# Parts of a sound model's labels and what they are called, the first match counts; the sounds that voices make.
SOUND_LABELS = (
    ("chink, clink", "Glass clink"), ("glass", "Glass sound"), ("cutlery", "Cutlery"), ("silverware", "Cutlery"), ("dishes", "Dishes"), ("pots, and pans", "Dishes"), ("laughter", "Laughter"), ("giggle", "Giggle"), ("chuckle", "Chuckle"), ("crying", "Crying"), ("sobbing", "Sobbing"),
    ("cough", "Cough"), ("sneeze", "Sneeze"), ("applause", "Applause"), ("clapping", "Clapping"), ("music", "Music"), ("siren", "Siren"), ("alarm", "Alarm"), ("vehicle", "Vehicle"), ("car", "Car"), ("motorcycle", "Motorcycle"),
    ("footsteps", "Footsteps"), ("typing", "Typing"), ("door", "Door"), ("knock", "Knock"), ("explosion", "Explosion"), ("gunshot", "Gunshot"), ("wind", "Wind"), ("rain", "Rain"), ("thunder", "Thunder"), ("noise", "Noise"),
)
VOCAL_SOUNDS = ("Laughter", "Giggle", "Chuckle", "Crying", "Sobbing", "Cough", "Sneeze")

# Words of a wish that ask for a kind of scene, and words that make it exclusive.
REQUEST_TYPES = {"action": ("aksiyon", "action", "dövüş", "kovalamaca", "çatışma"), "dialogue": ("konuşma", "konuşmalı", "diyalog", "dialogue"), "silent": ("konuşmasız", "sessiz", "silent", "no dialogue"), "music": ("müzik", "müzikli", "music")}
STRICT_MARKERS = ("sadece", "yalnız", "yalnızca", "only ")
