"""Fixed values that results depend on, stated once."""

# Request defaults and limits.
DEFAULT_DIM = 768
DEFAULT_PREFIX = "search_query"
PREFIXES = ("search_query", "search_document", "classification", "clustering")
MAX_IMAGE_BYTES = 20 * 1024 * 1024
MAX_TEXT_BATCH = 16
MAX_IMAGE_BATCH = 4
ZERO_NORM = 1e-9

# Image preprocessing.
IMAGE_SIZE = 224
IMAGE_MEAN = (0.48145466, 0.4578275, 0.40821073)
IMAGE_STD = (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

# Colour statistics.
THUMBNAIL_SIZE = 512
ALPHA_THRESHOLD = 128
GEOMETRIC_EPS = 1e-8
HUE_EPS = 1e-6
AVERAGE_TOLERANCE = 0.03
DOMINANT_TOLERANCE = 0.05

# Offline tokeniser (letter or digit runs, else one other visible character).
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SPECIAL_TOKENS = 2

# Matryoshka widths shown by default.
MATRYOSHKA_DIMS = (768, 512, 256, 128, 64)

# Interference and verdict thresholds.
IDENTICAL_DIFF = 1e-4
MINIMAL_DIFF = 0.01
SIGNIFICANT_DIM_DIFF = 0.001
PERFECT_COSINE = 0.9999
ACCEPTABLE_COSINE = 0.98

# Sizes a side may have and still be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
