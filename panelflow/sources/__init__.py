"""panelflow sources"""
