"""Fixed values that results depend on; change one and outputs change."""

# Output formats, their file extensions and media types.
SUPPORTED_FORMATS = ("webp", "png", "jpg", "jpeg")
BENCH_FORMATS = ("webp", "png", "jpg")
DEFAULT_FORMAT = "webp"
MEDIA_TYPES = {
    "webp": "image/webp",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}

# Render defaults.
TARGET_WIDTH = 1280
SCAN_WIDTH = 1024
MAX_SCALE = 4.0
WEBP_MAX_SIDE = 16383
RASTER_MAX_SIDE = 32767
DEFAULT_PAGE_WIDTH_PT = 612.0
DEFAULT_PAGE_HEIGHT_PT = 792.0

# Encoder defaults.
WEBP_QUALITY = 80
WEBP_METHOD = 4
JPEG_QUALITY = 85
LEGACY_JPEG_QUALITY = 80
PNG_LEVEL = 6

# Byte-range reads.
BLOCK_BYTES = 256 * 1024
CACHE_BLOCKS = 64
RESPONSE_TIMEOUT_MS = 30_000

# Reports.
BENCH_MAX_PAGES = 10

# Error texts of failed pages and documents.
LOAD_FAILED = "Failed to load PDF: "
NO_RENDERER = "Native renderer not available in worker thread"
NO_INPUT = "No input provided: filePath or pdfBuffer required"
RENDER_FAILED = "Render failed"
UNKNOWN_ERROR = "Unknown error"
SAVE_FAILED = "File save failed: "
UPLOAD_FAILED = "Upload failed: "
INVALID_PAGE = ("Invalid page number: ", " (total: ", ")")
UNSUPPORTED_FORMAT = ("Unsupported format: ", ". Supported formats: ")
DOWNLOAD_FAILED = "Failed to download file: "
SIZE_PROBE_FAILED = "Failed to get file size: "
NO_CONTENT_LENGTH = "Server did not return Content-Length header"

# How error texts begin, by failure class. First match wins.
ERROR_PREFIXES = (
    ("load", ("Failed to load PDF", "File not found or not readable")),
    ("page-range", ("Invalid page number",)),
    ("page-fetch", ("Failed to get page",)),
    ("render", ("Failed to render page", "Render failed")),
    (
        "encode",
        (
            "Failed to encode image",
            "Failed to create image buffer",
            "Failed to create WebPConfig",
            "WebP encoding failed",
            "PNG encoding failed",
            "JPG encoding failed",
            "Unsupported format",
        ),
    ),
    ("save", ("File save failed",)),
    ("upload", ("Upload failed",)),
    (
        "unavailable",
        (
            "Native renderer not available",
            "Native renderer is not available",
            "PDFium library not available",
        ),
    ),
)
