"""parcelmill: shipment-evidence analytics as declarative Spark plans."""
