"""Fixed values that results depend on (formats, limits, published code tables)."""

# Presets (key, mode, colour mode, dpi, quality, colours).
PRESETS = [
    ("verlustfrei", "lossless", None, None, None, None),
    ("leicht", "raster", "color", 200, 0.80, None),
    ("mittel", "raster", "color", 150, 0.62, None),
    ("stark", "raster", "color", 110, 0.45, None),
    ("extrem-grau", "raster", "gray", 100, 0.40, None),
    ("extrem-farbe", "raster", "indexed", 150, None, 16),
    ("extrem-sw", "raster", "bw", 300, None, None),
]
PRESET_SCHEMA = "preset string, mode string, color_mode string, dpi int, quality double, colors int"

# Sizes and limits.
A4_SHORT_PT = 595.28
A4_LONG_PT = 841.89
OVERSIZE_AREA_PT2 = 1.7e6
MAX_PIXELS_BW = 16e6
MAX_PIXELS_OTHER = 12e6
IMPORT_MAX_EDGE = 3200
DETECT_MAX_EDGE = 440
SHEET_MAX_EDGE = 700
OUTPUT_MAX_EDGE = 2800
UPLOAD_LIMIT = 200 * 1024 * 1024
PROFILE_LIMIT = 8 * 1024 * 1024
BLOCK = 32
NAME_SUFFIX_LAST = 498

# Accepted file name endings.
INTAKE_ENDING = r"(?i)\.(pdf|jpe?g|png|webp|heic|heif|tiff?|bmp)$"
IMPORT_ENDING = r"(?i)\.(jpe?g|png|webp|gif|bmp|avif)$"

# ITU-T T.4 code words. Terminating codes for runs 0..63, then
# make-up codes for runs 64, 128, .. 1728, then the extended make-up codes for
# 1792, 1856, .. 2560 that both colours share.
T4_WHITE_TERMINATING = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100"
    " 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011"
    " 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100"
    " 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100"
    " 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000"
    " 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
T4_WHITE_MAKEUP = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100"
    " 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001"
    " 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
T4_BLACK_TERMINATING = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100"
    " 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100"
    " 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100"
    " 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011"
    " 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010"
    " 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101"
    " 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000"
    " 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
T4_BLACK_MAKEUP = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101"
    " 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101"
    " 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111"
    " 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011"
    " 0000001100100 0000001100101"
).split()
T4_SHARED_MAKEUP = (
    "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101"
    " 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
).split()
# Two-dimensional codes of ITU-T T.6 (vertical by a1-b1, pass, horizontal, end).
T6_VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
T6_PASS = "0001"
T6_HORIZONTAL = "001"
T6_END_OF_BLOCK = "000000000001000000000001"
