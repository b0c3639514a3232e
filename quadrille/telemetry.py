"""Figures of the host that runs the driver."""

from __future__ import annotations

import os
import platform


def _share_of_memory() -> float:
    values = {}
    with open("/proc/meminfo") as f:
        for line in f:
            name, _, rest = line.partition(":")
            values[name] = float(rest.split()[0])
    return 100 * (1 - values["MemAvailable"] / values["MemTotal"])


def system() -> dict[str, object]:
    """Load and memory in per cent, and what else the host tells; `source` says whether figures were read or are unknown.

    Temperature and power are null where no sensor is readable: nothing is made up.
    """
    try:
        import psutil

        cpu, memory, source = psutil.cpu_percent(interval=None), psutil.virtual_memory().percent, "direct"
        heat = next((v[0].current for v in psutil.sensors_temperatures().values() if v), None)
    except Exception:  # no psutil, or a host without these calls
        heat = None
        try:
            cpu, memory, source = 100 * os.getloadavg()[0] / (os.cpu_count() or 1), _share_of_memory(), "system"
        except OSError:
            cpu, memory, source = 0.0, 0.0, "unknown"
    return {"cpu_percent": min(max(float(cpu), 0.0), 100.0), "ram_percent": min(max(float(memory), 0.0), 100.0), "temperature_c": heat, "power_watts": None, "gpu": "none", "gpu_available": False, "device": platform.machine(), "source": source}
