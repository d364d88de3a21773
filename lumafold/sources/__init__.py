"""Sources and sinks: the binary loop file, raw shot archives, images with sidecars, cached maps."""
