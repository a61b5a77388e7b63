"""panelflow plans"""
