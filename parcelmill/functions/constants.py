"""Domains, wordings, thresholds and patterns that results depend on."""

# Field sources and their priority.
SOURCES = ["OVERLAY_OCR", "BARCODE", "LABEL_OCR", "VISION_FALLBACK", "NOT_EXTRACTED"]
SOURCE_PRIORITY = {"BARCODE": 4, "OVERLAY_OCR": 3, "LABEL_OCR": 2, "VISION_FALLBACK": 1, "NOT_EXTRACTED": 0}

# Job stages; the terminal ones.
TERMINAL_STAGES = ["COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED"]

# Flags that ask for a review, and the reason each gives.
REVIEW_REASONS = {
    "MULTIPLE_PARCELS": "multiple_parcels",
    "PARCEL_PARTIALLY_VISIBLE": "parcel_partially_visible",
    "PARCEL_DETECTION_UNCERTAIN": "parcel_detection_uncertain",
    "LABEL_BLOCKED": "label_blocked",
    "LABEL_UNREADABLE": "label_unreadable",
    "LABEL_PARTIALLY_VISIBLE": "label_partially_visible",
    "MULTIPLE_LABEL_CANDIDATES": "multiple_label_candidates",
    "AWB_CONFLICT": "awb_conflict",
    "AWB_NOT_LABEL_VERIFIED": "awb_not_label_verified",
    "LOW_OCR_CONFIDENCE": "awb_below_clean_threshold",
}

# Statuses that count as a success.
GOOD_STATUSES = ["SUCCESS_LABEL_VERIFIED", "SUCCESS_OVERLAY_AND_LABEL", "SUCCESS_OVERLAY_ONLY", "SUCCESS_PARTIAL_FIELDS"]

# Plain wording of flags.
FLAG_TEXT = {
    "NO_PARCEL": "No parcel was found in the photo",
    "MULTIPLE_PARCELS": "More than one parcel is in the photo",
    "PARCEL_PARTIALLY_VISIBLE": "The parcel is only partly visible",
    "PARCEL_DETECTION_UNCERTAIN": "The system was unsure about the parcel",
    "LABEL_NOT_VISIBLE": "No shipping label was visible",
    "LABEL_BLOCKED": "The label was covered or blocked",
    "LABEL_UNREADABLE": "The label could not be read",
    "LABEL_PARTIALLY_VISIBLE": "The label was only partly visible",
    "MULTIPLE_LABEL_CANDIDATES": "Several possible labels were seen",
    "MULTIPLE_BARCODES": "More than one barcode was found",
    "AWB_NOT_FOUND": "No tracking number was found",
    "AWB_CONFLICT": "Two different tracking numbers were read",
    "AWB_NOT_LABEL_VERIFIED": "The tracking number was read only from the machine overlay",
    "DIMENSIONS_NOT_FOUND": "The size was not found",
    "WEIGHT_NOT_FOUND": "The weight was not found",
    "OVERLAY_NOT_FOUND": "The scale/machine reading was not found",
    "OVERLAY_PARTIAL": "The scale/machine reading was incomplete",
    "LOW_IMAGE_QUALITY": "The photo was blurry or dark",
    "LOW_OCR_CONFIDENCE": "The text was hard to read",
    "OCR_UNAVAILABLE": "Text reading was unavailable",
    "VISION_API_UNAVAILABLE": "The optional AI helper was unavailable",
    "DETECTOR_UNAVAILABLE": "The parcel detector model was unavailable",
    "UNSUPPORTED_IMAGE": "The file was not a supported image",
    "DUPLICATE_IMAGE": "This photo is a duplicate of another",
}

# Plain wording of reasons.
REASON_TEXT = {
    "processing_error": "The image could not be processed",
    "multiple_parcels": "More than one parcel is in the photo",
    "parcel_partially_visible": "The parcel is only partly visible",
    "parcel_detection_uncertain": "The system was unsure about the parcel",
    "label_not_visible": "No shipping label was visible",
    "label_blocked": "The label was covered or blocked",
    "label_unreadable": "The label could not be read",
    "label_partially_visible": "The label was only partly visible",
    "multiple_label_candidates": "Several possible labels were seen",
    "awb_not_found": "No tracking number was found",
    "awb_conflict": "Two different tracking numbers were read",
    "awb_not_label_verified": "The tracking number was read only from the machine overlay",
    "awb_below_clean_threshold": "The tracking number confidence was too low",
    "vision_unavailable_local_evidence_insufficient": "The optional AI helper was unavailable and the local evidence was insufficient",
}

# Text before a field's value.
ANCHORS = {
    "location": r"\bLocati[o0]n\b",
    "awb_number": r"\bAW[8B]\s*(?:No|Number)?\.?\b",
    "length_cm": r"\bLength\b",
    "width_cm": r"\bW\s*idth\b",
    "height_cm": r"\bHeight\b",
    "recorded_volume": r"\bR\.?\s*Vol\.?\b",
    "weight": r"\bW\s*eight\b",
    "capture_timestamp": r"\bTime\b",
}

# Characters that text recognition mistakes for digits.
MISREAD, DIGITS = "OoQIl|S", "0001115"

# Time formats, tried in turn.
TIME_FORMATS = ["M/d/yyyy h:mm:ss a", "d/M/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "d-M-yyyy H:mm:ss", "M-d-yyyy H:mm:ss", "yyyy-M-d H:mm:ss"]

# Thresholds.
PROMOTE, CLEAN, STRONG_ALTERNATIVE = 0.75, 0.90, 0.72
